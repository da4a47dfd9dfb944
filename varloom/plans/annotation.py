"""Queries and SQL of scans, scalar rules and joins over the stand-in views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import scalars as S
from ..operators.index import dense_index
from ..operators.intervals import running_max
from ..operators.joins import align_global, align_row, band_join, first_per, left_fill, range_join, range_max, unique_keys
from ..session import table
from . import lens
from .lens import ctes

MIN_SCORE = 0.015


def gwas_normalize(spark: SparkSession, d: str) -> DataFrame:
    """One row per variant: parsed identifier, finite z, chi-square from z or else as stored, weight."""
    g = lens.gwas(spark, d)
    chrom, pos = S.variant_id_parts("variant_id")
    z = S.finite_or(F.col("z"), None)
    chisq = F.coalesce(z * z, S.finite_or(F.col("chisq"), None))
    out = g.select("variant_idx", chrom.alias("chrom"), pos.alias("pos"), z.alias("z"), chisq.alias("chisq"), "n").where(S.autosomal("chrom") & F.col("chisq").isNotNull())
    return out.select("variant_idx", "chrom", "pos", F.round("z", 6).alias("z"), F.round("chisq", 6).alias("chisq"), F.round(S.regression_weight("chisq"), 6).alias("weight"), "n")


def gwas_effective_n(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(S.effective_n(F.col("p_size"), F.col("p_partkey") % 100), 6).alias("n_eff"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    links = lens.links(spark, d).where(F.col("score") >= MIN_SCORE)
    return range_join(lens.variants(spark, d), links, ["chrom"], "pos", "start", "end")


def cre_range_join(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("event_id", "gene", "cell_type", "score")


def _events(spark: SparkSession, d: str) -> tuple[DataFrame, bool]:
    """``event_id, chrom, pos`` of the variants, and whether an identifier has several rows."""
    v = lens.variants(spark, d).select("event_id", "chrom", "pos")
    return v, not v.groupBy("event_id").count().where("count > 1").isEmpty()


def _largest(spark: SparkSession, d: str, each: Column | None = None) -> DataFrame:
    """``event_id, gene, cell_type, score``: largest scores, without a shuffle of the hits unless identifiers repeat."""
    v, repeats = _events(spark, d)
    x = range_max(v, lens.links(spark, d).where(F.col("score") >= MIN_SCORE), ["chrom"], "pos", "start", "end", ["gene", "cell_type"], "score", each).drop("chrom", "pos")
    return x.groupBy("event_id", "gene", "cell_type").agg(F.max("score").alias("score")) if repeats else x


def cre_triples_max(spark: SparkSession, d: str) -> DataFrame:
    return _largest(spark, d).withColumnRenamed("score", "value")


def cre_intercept_union(spark: SparkSession, d: str) -> DataFrame:
    """Triples and an intercept of 1 for every distinct variant and gene."""
    one = lambda kind, value: F.struct(F.col("gene"), kind.alias("cell_type"), value.alias("score"))
    both = F.array(one(F.col("cell_type"), F.col("score")), one(F.lit("intercept"), F.lit(1.0)))
    return _largest(spark, d, both).withColumnsRenamed({"cell_type": "mechanism", "score": "value"})


def self_promoter_filter(spark: SparkSession, d: str) -> DataFrame:
    x = lens.links(spark, d).where(S.keeps_self_promoter("is_self_promoter") & S.member("cell_type", "A, N") & (F.col("score") >= MIN_SCORE))
    return x.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct("gene").alias("n_genes"))


def peak_membership_semi(spark: SparkSession, d: str) -> DataFrame:
    return range_join(lens.variants(spark, d), lens.peaks(spark, d), ["chrom"], "pos", "start", "end", how="left_semi").select("event_id", "chrom", "pos")


def peak_running_max(spark: SparkSession, d: str) -> DataFrame:
    x = running_max(lens.peaks(spark, d).select("chrom", "start", "end").distinct(), ["chrom"], "start", "end", "reach")
    return x.select("chrom", F.col("start").alias("from_pos"), F.col("end").alias("to_pos"), "reach")


def peak_context_pivot(spark: SparkSession, d: str) -> DataFrame:
    """All variants with one 0/1 column per context and their maximum as intercept."""
    contexts = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    hits = range_join(lens.variants(spark, d), lens.peaks(spark, d), ["chrom"], "pos", "start", "end")
    wide = hits.groupBy("event_id").agg(*[F.max((F.col("context") == c).cast("int")).alias(f"c{i}") for i, c in enumerate(contexts, 1)])
    names = [f"c{i}" for i in range(1, 6)]
    out = left_fill(lens.variants(spark, d).select("event_id"), wide, ["event_id"], {n: 0 for n in names})
    return out.withColumn("intercept", F.greatest(*names))


def tss_band_join(spark: SparkSession, d: str) -> DataFrame:
    """Variants inside a peak with the genes whose start lies within 20 kb."""
    v, repeats = _events(spark, d)
    t = lens.tss(spark, d)
    pairs = band_join(range_join(v, lens.peaks(spark, d), ["chrom"], "pos", "start", "end", how="left_semi"), t, ["chrom"], "pos", "tss", 20_000)
    pairs = pairs.select("event_id", "gene", F.abs(F.col("pos") - F.col("tss")).alias("distance"))
    # without repeated identifiers or genes no pair comes twice, and the pairs need no shuffle
    if repeats or not t.groupBy("chrom", "gene").count().where("count > 1").isEmpty():
        pairs = pairs.groupBy("event_id", "gene").agg(F.min("distance").alias("distance"))
    return pairs


def top_assoc_topk_genes(spark: SparkSession, d: str) -> DataFrame:
    """Triples of the 50 genes with the strongest association, valued by z squared."""
    g = lens.gwas(spark, d).select("variant_idx", S.annotation_value("z2").alias("z2")).where("z2 > 0")
    t = lens.triples(spark, d).join(g, "variant_idx").groupBy("gene_idx", "variant_idx").agg(F.max("z2").alias("value"))
    top = t.groupBy("gene_idx").agg(F.max("value").alias("best")).orderBy(F.col("best").desc(), "gene_idx").limit(50)
    return t.join(top.select("gene_idx"), "gene_idx", "left_semi").select("variant_idx", "gene_idx", F.round("value", 6).alias("value"))


def dense_index_variants(spark: SparkSession, d: str) -> DataFrame:
    v = lens.variants(spark, d).select("event_id", "chrom", "pos")
    return dense_index(v, [F.col("chrom"), F.col("pos"), F.col("event_id")], "idx").select("event_id", "idx")


def first_appearance_index(spark: SparkSession, d: str) -> DataFrame:
    """Cell types and return flags numbered by the order link keys first show them."""
    f = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey")).alias("first"))
    w = W.orderBy("first", "l_returnflag", "l_linestatus")
    return f.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), (F.row_number().over(w) - 1).alias("idx"))


def align_priority_global(spark: SparkSession, d: str) -> DataFrame:
    """Stored folds' variants with a statistic: by marker, as any marker matches; and, of identifiers that no marker equals, by the variant."""
    right = lens.gwas(spark, d).where("z is not null").withColumn("vid", F.col("variant_idx")).select("markerid", "vid", "loaded_at", "z", "variant_idx")
    names = lens.gwas(spark, d).select(F.col("variant_idx").alias("fold_idx"), F.col("markerid").alias("m"))
    left = table(spark, d, "cv_folds").select(F.col("variant_idx").alias("fold_idx")).distinct().join(names, "fold_idx")
    keys, order, out = [("m", "markerid"), ("fold_idx", "vid")], [F.col("loaded_at"), F.col("variant_idx")], None
    for x in (left, left.withColumn("m", F.concat(F.lit("none"), "fold_idx"))):
        joined, key = align_global(x, right, keys, order)
        part = joined.select("fold_idx", F.lit(key).alias("used_key"), "variant_idx")
        out = part if out is None else out.union(part)
    return out


def align_priority_row(spark: SparkSession, d: str) -> DataFrame:
    """Every variant's sample size: by marker, else by identifier; of repeated keys the last loaded counts."""
    v = table(spark, d, "variants")
    left = v.select("variant_idx", "markerid", "variant_id").groupBy("variant_idx").agg(F.max("markerid").alias("markerid"), F.max("variant_id").alias("variant_id"))
    known = v.where("n is not null").select("markerid", F.col("variant_id").alias("vid"), "n", "loaded_at", F.col("variant_idx").alias("vi"))
    return align_row(left, known, [("markerid", "markerid"), ("variant_id", "vid")], "n", [F.col("loaded_at"), F.col("vi"), F.col("n")]).select("variant_idx", "n")


def unique_coord_join(spark: SparkSession, d: str) -> DataFrame:
    """Variants joined to the reference coordinates that no second marker shares."""
    v = lens.gwas(spark, d).select("variant_idx", "chrom", "pos")
    u = unique_keys(v.select("chrom", "pos", F.col("variant_idx").alias("ref_idx")), ["chrom", "pos"])
    return v.join(u, ["chrom", "pos"]).select("variant_idx", "ref_idx")


def annot_left_fill(spark: SparkSession, d: str) -> DataFrame:
    """Every variant with the sum and the number of its annotations, zero where there are none."""
    v = table(spark, d, "variants").select("variant_idx").distinct()
    s = lens.triples(spark, d).groupBy("variant_idx").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n_links"))
    return left_fill(v, s, ["variant_idx"], {"total": 0.0, "n_links": 0}).select("variant_idx", F.round("total", 6).alias("total"), "n_links")


def match_key_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Ranked genes of the global analyses with the number of sources that hold their key (dual-key lookup)."""
    r = table(spark, d, "rankings").where("ensembl is not null")
    keyed = r.select("source", "analysis", S.match_key("ensembl", "symbol").alias("key"))
    n = keyed.groupBy("key").agg(F.count_distinct("source").alias("n_sources"))
    return keyed.where("analysis = 'global'").select("source", "key").distinct().join(n, "key").select("source", "key", "n_sources")


def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Links and peaks as one table of intervals; the columns that one side lacks are null."""
    a = lens.links(spark, d).select("chrom", "start", "end", "gene")
    b = lens.peaks(spark, d).select("chrom", "start", "end", "context")
    u = a.unionByName(b, allowMissingColumns=True)
    return u.groupBy("chrom", "context").agg(F.count(F.lit(1)).alias("n"), F.count("gene").alias("n_gene"), F.sum(F.col("end") - F.col("start")).alias("bases"))


def universe_difference(spark: SparkSession, d: str) -> DataFrame:
    """Variants without any annotation, and annotated ones without a statistic."""
    v = lens.gwas(spark, d).where("z is not null").select("variant_idx")
    t = lens.triples(spark, d).select("variant_idx").distinct()
    return v.subtract(t).withColumn("side", F.lit("no_annotation")).union(t.subtract(v).withColumn("side", F.lit("no_statistic")))


def region_assign(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 3 Mb by arithmetic, with their variants and span."""
    v = lens.gwas(spark, d).withColumn("region", F.floor((F.col("pos") - 1) / 3_000_000))
    return v.groupBy("chrom", "region").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def liftover_unique(spark: SparkSession, d: str) -> DataFrame:
    """Positions mapped through ungapped blocks; only those that map once, to a place no other does."""
    from ..operators.liftover import lift

    blocks = lens.peaks(spark, d).select("chrom", "start", "end").distinct()
    blocks = first_per(blocks, ["chrom", "start"], [F.col("end")])
    blocks = blocks.select("chrom", "start", "end", F.col("chrom").alias("to_chrom"), (F.col("start") + 1000).alias("to_start"), (F.col("start") % 2 == 0).alias("forward"))
    return lift(lens.variants(spark, d).select("event_id", "chrom", "pos"), blocks, "event_id").select("event_id", "to_chrom", "to_pos")


QUERIES = {
    "gwas_normalize": gwas_normalize,
    "gwas_effective_n": gwas_effective_n,
    "cre_range_join": cre_range_join,
    "cre_triples_max": cre_triples_max,
    "cre_intercept_union": cre_intercept_union,
    "self_promoter_filter": self_promoter_filter,
    "peak_membership_semi": peak_membership_semi,
    "peak_running_max": peak_running_max,
    "peak_context_pivot": peak_context_pivot,
    "tss_band_join": tss_band_join,
    "top_assoc_topk_genes": top_assoc_topk_genes,
    "dense_index": dense_index_variants,
    "first_appearance_index": first_appearance_index,
    "align_priority_global": align_priority_global,
    "align_priority_row": align_priority_row,
    "unique_coord_join": unique_coord_join,
    "annot_left_fill": annot_left_fill,
    "match_key_enrich": match_key_enrich,
    "union_by_name": union_by_name,
    "universe_difference": universe_difference,
    "region_assign": region_assign,
    "liftover_unique": liftover_unique,
}

_HITS = ctes("vv", "l") + ", h AS (SELECT v.event_id, l.gene, l.cell_type, l.score FROM v JOIN l ON v.chrom = l.chrom AND v.pos BETWEEN l.s AND l.e WHERE l.score >= 0.015)"
_INPEAK = "ip AS (SELECT * FROM v WHERE EXISTS (SELECT 1 FROM p WHERE p.chrom = v.chrom AND v.pos BETWEEN p.s AND p.e))"

ORACLES = {
    "gwas_normalize": ctes("g")
    + r""", x AS (SELECT variant_idx, CAST(regexp_extract(variant_id, '^chr(\d+):', 1) AS INT) AS chrom, CAST(regexp_extract(variant_id, '^chr\d+:(\d+)', 1) AS BIGINT) AS pos,
      CASE WHEN isfinite(z) THEN z END AS z, CASE WHEN isfinite(chisq) THEN chisq END AS c, n FROM g),
      y AS (SELECT *, coalesce(z * z, c) AS chisq FROM x)
      SELECT variant_idx, chrom, pos, round(z, 6) AS z, round(chisq, 6) AS chisq, round(1.0 / greatest(chisq, 1.0), 6) AS weight, n FROM y WHERE chrom BETWEEN 1 AND 22 AND chisq IS NOT NULL""",
    "gwas_effective_n": "SELECT p_partkey, round(CASE WHEN p_size + p_partkey % 100 <> 0 THEN 4.0 * (CAST(p_size AS DOUBLE) * (p_partkey % 100)) / (p_size + p_partkey % 100) END, 6) AS n_eff FROM part",
    "cre_range_join": _HITS + " SELECT * FROM h",
    "cre_triples_max": _HITS + " SELECT event_id, gene, cell_type, max(score) AS value FROM h GROUP BY ALL",
    "cre_intercept_union": _HITS + " SELECT event_id, gene, cell_type AS mechanism, max(score) AS value FROM h GROUP BY ALL UNION ALL SELECT DISTINCT event_id, gene, 'intercept', 1.0 FROM h",
    "self_promoter_filter": ctes("l") + " SELECT cell_type, count(*) AS n_links, count(DISTINCT gene) AS n_genes FROM l WHERE NOT is_self_promoter AND cell_type IN ('A', 'N') AND score >= 0.015 GROUP BY ALL",
    "peak_membership_semi": ctes("vv", "p") + f", {_INPEAK} SELECT event_id, chrom, pos FROM ip",
    "peak_running_max": ctes("p") + " SELECT chrom, s AS from_pos, e AS to_pos, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS reach FROM (SELECT DISTINCT chrom, s, e FROM p)",
    "peak_context_pivot": ctes("vv", "p")
    + ", h AS (SELECT v.event_id, "
    + ", ".join(f"max(CAST(context LIKE '{i}-%' AS INT)) AS c{i}" for i in range(1, 6))
    + " FROM v JOIN p ON v.chrom = p.chrom AND v.pos BETWEEN p.s AND p.e GROUP BY ALL), w AS (SELECT v.event_id, "
    + ", ".join(f"coalesce(c{i}, 0) AS c{i}" for i in range(1, 6))
    + " FROM v LEFT JOIN h USING (event_id)) SELECT *, greatest(c1, c2, c3, c4, c5) AS intercept FROM w",
    "tss_band_join": ctes("vv", "p", "t") + f", {_INPEAK} SELECT event_id, gene, min(abs(pos - tss)) AS distance FROM ip JOIN t ON ip.chrom = t.chrom AND abs(ip.pos - t.tss) <= 20000 GROUP BY ALL",
    "top_assoc_topk_genes": ctes("g", "a")
    + """, z AS (SELECT variant_idx, CASE WHEN isfinite(z * z) THEN z * z WHEN z IS NOT NULL THEN 0.0 END AS z2 FROM g),
      x AS (SELECT gene_idx, variant_idx, max(z2) AS value FROM a JOIN z USING (variant_idx) WHERE z2 > 0 GROUP BY ALL),
      top AS (SELECT gene_idx FROM x GROUP BY gene_idx ORDER BY max(value) DESC, gene_idx LIMIT 50)
      SELECT variant_idx, gene_idx, round(value, 6) AS value FROM x WHERE gene_idx IN (SELECT gene_idx FROM top)""",
    "dense_index": ctes("vv") + " SELECT event_id, row_number() OVER (ORDER BY chrom, pos, event_id) - 1 AS idx FROM v",
    "first_appearance_index": "WITH f AS (SELECT l_returnflag AS flag, l_linestatus AS status, min(row(l_orderkey, l_linenumber, l_partkey)) AS first FROM lineitem GROUP BY ALL) SELECT flag, status, CAST(row_number() OVER (ORDER BY first, flag, status) - 1 AS INT) AS idx FROM f",
    "align_priority_global": ctes("g")
    + """, c AS (SELECT DISTINCT variant_idx FROM cv_folds), r AS (SELECT *, row_number() OVER (PARTITION BY markerid ORDER BY loaded_at NULLS FIRST, variant_idx) AS k FROM g WHERE z IS NOT NULL AND markerid IS NOT NULL)
      SELECT c.variant_idx AS fold_idx, 'm' AS used_key, r.variant_idx FROM c JOIN g USING (variant_idx) JOIN r ON g.markerid = r.markerid WHERE r.k = 1
      UNION ALL SELECT c.variant_idx, 'fold_idx', g.variant_idx FROM c JOIN g USING (variant_idx) WHERE g.z IS NOT NULL""",
    "align_priority_row": """WITH lft AS (SELECT variant_idx, max(markerid) AS markerid, max(variant_id) AS variant_id FROM variants GROUP BY 1),
      k AS (SELECT *, row(loaded_at, variant_idx, n) AS o FROM variants WHERE n IS NOT NULL),
      m AS (SELECT markerid, max_by(n, o) AS n FROM k WHERE markerid IS NOT NULL GROUP BY 1),
      i AS (SELECT variant_id, max_by(n, o) AS n FROM k WHERE variant_id IS NOT NULL GROUP BY 1)
      SELECT variant_idx, coalesce(m.n, i.n) AS n FROM lft LEFT JOIN m USING (markerid) LEFT JOIN i ON i.variant_id = lft.variant_id""",
    "unique_coord_join": ctes("g") + ", u AS (SELECT chrom, pos, min(variant_idx) AS ref_idx FROM g GROUP BY ALL HAVING count(*) = 1) SELECT g.variant_idx, u.ref_idx FROM g JOIN u USING (chrom, pos)",
    "annot_left_fill": ctes("a") + " SELECT variant_idx, round(coalesce(sum(value), 0), 6) AS total, count(value) AS n_links FROM (SELECT DISTINCT variant_idx FROM variants) LEFT JOIN a USING (variant_idx) GROUP BY 1",
    "match_key_enrich": """WITH k AS (SELECT source, analysis, CASE WHEN upper(split_part(ensembl, '.', 1)) LIKE 'ENSG%' THEN upper(split_part(ensembl, '.', 1)) ELSE upper(symbol) END AS key FROM rankings WHERE ensembl IS NOT NULL),
      n AS (SELECT key, count(DISTINCT source) AS n_sources FROM k GROUP BY 1)
      SELECT DISTINCT source, key, n_sources FROM k JOIN n USING (key) WHERE analysis = 'global'""",
    "union_by_name": ctes("l", "p")
    + """, u AS (SELECT chrom, s, e, gene, NULL AS context FROM l UNION ALL SELECT chrom, s, e, NULL, context FROM p)
      SELECT chrom, context, count(*) AS n, count(gene) AS n_gene, CAST(sum(e - s) AS BIGINT) AS bases FROM u GROUP BY ALL""",
    "universe_difference": ctes("g", "a")
    + """, s AS (SELECT variant_idx FROM g WHERE z IS NOT NULL), t AS (SELECT DISTINCT variant_idx FROM a)
      SELECT variant_idx, 'no_annotation' AS side FROM s WHERE variant_idx NOT IN (SELECT variant_idx FROM t)
      UNION ALL SELECT variant_idx, 'no_statistic' FROM t WHERE variant_idx NOT IN (SELECT variant_idx FROM s)""",
    "region_assign": ctes("g") + " SELECT chrom, (pos - 1) // 3000000 AS region, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM g GROUP BY ALL",
    "liftover_unique": ctes("vv", "p")
    + """, b AS (SELECT chrom, s, min(e) AS e FROM p GROUP BY ALL),
      m AS (SELECT v.event_id, v.chrom AS to_chrom, CASE WHEN s % 2 = 0 THEN s + 1000 + (pos - s) ELSE s + 1000 + (e - 1 - pos) END AS to_pos FROM v JOIN b ON v.chrom = b.chrom AND pos >= s AND pos < e),
      once AS (SELECT event_id, min(to_chrom) AS to_chrom, min(to_pos) AS to_pos FROM m GROUP BY 1 HAVING count(*) = 1)
      SELECT event_id, to_chrom, to_pos FROM (SELECT *, count(*) OVER (PARTITION BY to_chrom, to_pos) AS c FROM once) WHERE c = 1""",
}
