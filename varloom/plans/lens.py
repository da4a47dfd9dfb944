"""Views over the standard tables that stand in for association, link, peak and gene inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import variant_id
from ..operators.joins import first_per
from ..operators.sparse import clean_triples, ld_pairs, symmetric
from ..session import table

#: Length of the stand-in chromosomes.
SPAN = 2_592_000


def variants(spark: SparkSession, d: str) -> DataFrame:
    """``events`` as associations: chromosome from the user, position from the time."""
    e = table(spark, d, "events")
    secs = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    v = e.select(F.col("event_id"), (1 + F.col("user_id") % 22).cast("int").alias("chrom"), (1 + secs).alias("pos"), F.concat(F.lit("rs"), "event_id").alias("marker"), ((F.col("value") - 250) / 100).alias("z"))
    return v.withColumn("variant_id", variant_id("chrom", "pos"))


def links(spark: SparkSession, d: str) -> DataFrame:
    """``lineitem`` as scored links of intervals to genes."""
    li = table(spark, d, "lineitem")
    start = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % SPAN
    x = li.select(
        (1 + F.col("l_suppkey") % 22).cast("int").alias("chrom"), start.alias("start"), F.col("l_quantity").cast("long").alias("q"),
        F.concat(F.lit("G"), "l_partkey").alias("gene"), F.col("l_discount").alias("score"), F.col("l_returnflag").alias("cell_type"), (F.col("l_linestatus") == "O").alias("is_self_promoter"),
    )
    return x.withColumn("end", F.col("start") + F.col("q") * 20).drop("q")


def peaks(spark: SparkSession, d: str) -> DataFrame:
    """``orders`` as open intervals of a context."""
    o = table(spark, d, "orders")
    start = (F.col("o_orderkey") * 6151) % SPAN
    return o.select((1 + F.col("o_custkey") % 22).cast("int").alias("chrom"), start.alias("start"), (start + 50 + F.col("o_orderkey") % 500).alias("end"), F.col("o_orderpriority").alias("context"))


def tss(spark: SparkSession, d: str) -> DataFrame:
    """``part`` as gene starts of a context."""
    p = table(spark, d, "part")
    return p.select((1 + F.col("p_partkey") % 22).cast("int").alias("chrom"), (1 + (F.col("p_partkey") * 3571) % SPAN).alias("tss"), F.concat(F.lit("G"), "p_partkey").alias("gene"), (F.col("p_size") % 5).cast("int").alias("context_idx"))


def gwas(spark: SparkSession, d: str) -> DataFrame:
    """``variants`` with one row for each identifier: the earliest loaded, nulls first."""
    v = table(spark, d, "variants")
    cols = ["variant_idx", "loaded_at", "z", "chisq", "n", "markerid", "variant_id", "chrom", "pos"]
    return first_per(v.select(*cols), ["variant_idx"], [F.col(c) for c in cols[1:6]])


def triples(spark: SparkSession, d: str) -> DataFrame:
    return clean_triples(table(spark, d, "annotation_triples"))


def matrix(spark: SparkSession, d: str, cut: float = 0.01) -> DataFrame:
    """The symmetric matrix over all variants."""
    return symmetric(ld_pairs(table(spark, d, "ld_blocks"), cut), table(spark, d, "variants").select("variant_idx").distinct())


#: The same views in DuckDB SQL, as common table expressions.
SQL = {
    "vv": """vv AS (SELECT event_id, CAST(1 + user_id % 22 AS INT) AS chrom, 1 + (epoch_us(ts) // 1000000 - 1704067200) AS pos,
      'rs' || event_id AS marker, (value - 250) / 100 AS z FROM events),
      v AS (SELECT *, 'chr' || chrom || ':' || pos AS variant_id FROM vv)""",
    "l": """l AS (SELECT CAST(1 + l_suppkey % 22 AS INT) AS chrom, (l_orderkey * 7919 + l_linenumber * 104729) % 2592000 AS s,
      (l_orderkey * 7919 + l_linenumber * 104729) % 2592000 + CAST(trunc(l_quantity) AS BIGINT) * 20 AS e, 'G' || l_partkey AS gene, l_discount AS score,
      l_returnflag AS cell_type, l_linestatus = 'O' AS is_self_promoter FROM lineitem)""",
    "p": """p AS (SELECT CAST(1 + o_custkey % 22 AS INT) AS chrom, (o_orderkey * 6151) % 2592000 AS s, (o_orderkey * 6151) % 2592000 + 50 + o_orderkey % 500 AS e,
      o_orderpriority AS context FROM orders)""",
    "t": """t AS (SELECT CAST(1 + p_partkey % 22 AS INT) AS chrom, 1 + (p_partkey * 3571) % 2592000 AS tss, 'G' || p_partkey AS gene, CAST(p_size % 5 AS INT) AS context_idx FROM part)""",
    "g": """g AS (SELECT * EXCLUDE (nr) FROM (SELECT *, row_number() OVER (PARTITION BY variant_idx ORDER BY loaded_at NULLS FIRST, z NULLS FIRST, chisq NULLS FIRST, n NULLS FIRST, markerid NULLS FIRST) AS nr FROM variants) WHERE nr = 1)""",
    "a": """a AS (SELECT variant_idx, gene_idx, mechanism_idx, max(value) AS value FROM annotation_triples
      WHERE variant_idx >= 0 AND gene_idx >= 0 AND isfinite(value) AND value >= 0 GROUP BY ALL)""",
    "ld": """ldp AS (SELECT chrom, region, least(row_idx, col_idx) AS a, greatest(row_idx, col_idx) AS b, max(r2) AS r2 FROM ld_blocks
      WHERE isfinite(r2) AND r2 >= 0.01 AND r2 <= 1 AND row_idx <> col_idx GROUP BY ALL),
      ld AS (SELECT a AS row_idx, b AS col_idx, r2 FROM ldp UNION ALL SELECT b, a, r2 FROM ldp
      UNION ALL SELECT variant_idx, variant_idx, 1.0 FROM (SELECT DISTINCT variant_idx FROM variants))""",
}


def ctes(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
