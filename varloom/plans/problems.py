"""Queries and SQL of the general data problems: intervals (3) and lines that fail to parse (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.intervals import autosome, periods_and_gaps
from ..session import table
from ..sources.records import parse_lines, parse_records


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "peaks").where("start >= 0").withColumn("autosome", autosome("chrom"))
    p = p.where("sample_id is not null and autosome is not null")
    out = periods_and_gaps(p, ["sample_id", "autosome"], "start", "end", ["sample_id", "chrom"])
    return out.select("sample_id", "chrom", "kind", "from_pos", "to_pos")


def p3_cover(spark: SparkSession, d: str) -> DataFrame:
    """Covered and open bases of each sample and chromosome."""
    f = p3_found(spark, d)
    size = F.col("to_pos") - F.col("from_pos")
    return f.groupBy("sample_id", "chrom").agg(
        F.count_if(F.col("kind") == "period").alias("n_periods"),
        F.sum(F.when(F.col("kind") == "period", size).otherwise(0)).alias("covered"),
        F.sum(F.when(F.col("kind") == "gap", size).otherwise(0)).alias("open"),
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_records(table(spark, d, "raw_records")).where("reason is not null").select("record_id", "reason")


def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The valid rows of both feeds, typed."""
    r = parse_records(table(spark, d, "raw_records")).where("reason is null")
    return r.select("record_id", "feed", "chrom", F.col("start").alias("from_pos"), F.col("end").alias("to_pos"), "name", "score", "source_index")


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    """The valid records of the feeds' files, each file read as text with resumption at anchors."""
    r = parse_lines(table(spark, d, "raw_records")).where("reason is null")
    return r.select(F.col("path").alias("file_name"), "line", "chrom", F.col("start").alias("from_pos"), F.col("end").alias("to_pos"), "name", "score", "source_index")


QUERIES = {"p3_found": p3_found, "p3_cover": p3_cover, "p5_found": p5_found, "p5_loaded": p5_loaded, "p5_files": p5_files}

_P3 = """
WITH x AS (
  SELECT sample_id, CAST(regexp_extract(chrom, '^(?:[cC][hH][rR])?([1-9]|1[0-9]|2[0-2])$', 1) AS INT) AS chrom, "start" AS s, "end" AS e
  FROM peaks
  WHERE sample_id IS NOT NULL AND "start" >= 0 AND "start" < "end"
    AND regexp_matches(chrom, '^(?:[cC][hH][rR])?([1-9]|1[0-9]|2[0-2])$')),
y AS (SELECT *, max(e) OVER (PARTITION BY sample_id, chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
z AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id, chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM y),
periods AS (SELECT sample_id, chrom, min(s) AS from_pos, max(e) AS to_pos FROM z GROUP BY sample_id, chrom, island),
gaps AS (SELECT sample_id, chrom, to_pos AS from_pos, lead(from_pos) OVER (PARTITION BY sample_id, chrom ORDER BY from_pos) AS to_pos FROM periods),
found AS (
  SELECT sample_id, chrom, 'period' AS kind, from_pos, to_pos FROM periods
  UNION ALL SELECT sample_id, chrom, 'gap', from_pos, to_pos FROM gaps WHERE to_pos IS NOT NULL)
"""

# one closing carriage return is taken off; the fields of a line whose quoting holds are cut at the tabs outside quotes
_P5 = r"""
WITH x AS (
  SELECT record_id, feed, regexp_replace(line, '\r$', '') AS l FROM raw_records),
y AS (
  SELECT record_id, feed, l, regexp_full_match(l, '(?s)(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*') AS quoted_well
  FROM x
  WHERE l IS NOT NULL AND NOT regexp_full_match(l, '\s*') AND NOT (l LIKE '#%' OR l LIKE 'track%' OR l LIKE 'browser%')),
f AS (
  SELECT record_id, feed, quoted_well,
    list_transform(regexp_extract_all(chr(9) || l, '(?s)\t(?:"(?:[^"]|"")*"|[^"\t]*)'),
      lambda t: CASE WHEN t[2] = '"' THEN replace(t[3:len(t)-1], '""', '"') ELSE t[2:] END) AS c
  FROM y),
g AS (
  SELECT record_id, feed, quoted_well, c, len(c) = CASE feed WHEN 'peaks' THEN 5 ELSE 4 END AS counted,
    regexp_full_match(c[1], '(?:[cC][hH][rR])?(?:[1-9]|1[0-9]|2[0-2])')
    AND regexp_full_match(c[2], '0*[0-9]{1,9}') AND regexp_full_match(c[3], '0*[0-9]{1,9}')
    AND TRY_CAST(c[2] AS BIGINT) < TRY_CAST(c[3] AS BIGINT) AND TRY_CAST(c[3] AS BIGINT) <= 250000000
    AND CASE feed WHEN 'peaks' THEN regexp_full_match(c[5], '\.|[0-9]+(?:\.[0-9]+)?')
        ELSE regexp_full_match(c[4], '[0-9]+') AND TRY_CAST(c[4] AS BIGINT) IS NOT NULL END AS valued
  FROM f),
parsed AS (
  SELECT *, CASE WHEN NOT quoted_well THEN 'quoting' WHEN NOT counted THEN 'columns' WHEN valued IS DISTINCT FROM true THEN 'value' END AS reason FROM g)
"""

ORACLES = {
    "p3_found": _P3 + "SELECT sample_id, chrom, kind, from_pos, to_pos FROM found",
    "p3_cover": _P3
    + """SELECT sample_id, chrom, CAST(count(*) FILTER (WHERE kind = 'period') AS BIGINT) AS n_periods,
      CAST(coalesce(sum(to_pos - from_pos) FILTER (WHERE kind = 'period'), 0) AS BIGINT) AS covered,
      CAST(coalesce(sum(to_pos - from_pos) FILTER (WHERE kind = 'gap'), 0) AS BIGINT) AS "open"
    FROM found GROUP BY sample_id, chrom""",
    "p5_found": _P5 + "SELECT record_id, reason FROM parsed WHERE reason IS NOT NULL",
    "p5_loaded": _P5
    + """SELECT record_id, feed, CAST(regexp_extract(c[1], '[0-9]+') AS INT) AS chrom, CAST(c[2] AS BIGINT) AS from_pos, CAST(c[3] AS BIGINT) AS to_pos,
      CASE feed WHEN 'peaks' THEN c[4] END AS name,
      CASE WHEN feed = 'peaks' AND c[5] <> '.' THEN CAST(c[5] AS DOUBLE) END AS score,
      CASE feed WHEN 'lifted' THEN CAST(c[4] AS BIGINT) END AS source_index
    FROM parsed WHERE reason IS NULL""",
    "p5_files": _P5
    + r""", pl AS (SELECT record_id, file_name, CAST(1 + coalesce(sum(1 + length(coalesce(line, '')) - length(replace(coalesce(line, ''), chr(10), '')))
        OVER (PARTITION BY feed, file_name ORDER BY line_no, coalesce(line, '') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line FROM raw_records)
    SELECT file_name, pl.line, CAST(regexp_extract(c[1], '[0-9]+') AS INT) AS chrom, CAST(c[2] AS BIGINT) AS from_pos, CAST(c[3] AS BIGINT) AS to_pos,
      CASE feed WHEN 'peaks' THEN c[4] END AS name, CASE WHEN feed = 'peaks' AND c[5] <> '.' THEN CAST(c[5] AS DOUBLE) END AS score,
      CASE feed WHEN 'lifted' THEN CAST(c[4] AS BIGINT) END AS source_index
    FROM parsed JOIN pl USING (record_id) WHERE reason IS NULL""",
}
