"""Queries and SQL of the sparse algebra, the LD graph, folds and rankings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import scalars as S
from ..operators import folds as folding, graph, sparse as sp
from ..operators.index import running_sum
from ..operators.joins import antijoin_identity, first_per
from ..session import Scratch, table
from ..stats.fit import CheckpointStore, Fit, merge_stores
from . import lens
from .lens import ctes

#: Thresholds of the component sweep.
THRESHOLDS = [0.01, 0.05, 0.1, 0.3]
CONTEXTS = list(range(1, 10))


def coefficients(triples: DataFrame) -> DataFrame:
    """A fixed coefficient for every gene and mechanism with annotations."""
    c = ((F.col("gene_idx") * 7 + F.col("mechanism_idx") * 3) % 11) / 100
    return triples.select("gene_idx", "mechanism_idx").distinct().withColumn("coef", c)


def effects(spark: SparkSession) -> DataFrame:
    return spark.range(10).select(F.col("id").alias("mechanism_idx"), (F.col("id") / 50).alias("effect"))


def predicted_links_sum_pivot(spark: SparkSession, d: str) -> DataFrame:
    """All variants with one column per context: the sum of values over genes."""
    s = lens.triples(spark, d).groupBy("variant_idx").pivot("mechanism_idx", CONTEXTS).agg(F.sum("value"))
    v = table(spark, d, "variants").select("variant_idx").distinct()
    out = v.join(s, "variant_idx", "left").na.fill(0.0)
    return out.select("variant_idx", *[F.round(str(c), 6).alias(f"m{c}") for c in CONTEXTS])


def context_aggregate_sum(spark: SparkSession, d: str) -> DataFrame:
    return sp.context_scores(lens.triples(spark, d)).select("variant_idx", "mechanism_idx", F.round("value", 6).alias("value"))


def context_aggregate_binary(spark: SparkSession, d: str) -> DataFrame:
    return sp.context_scores(lens.triples(spark, d), "binary", [0])


def annotation_mass(spark: SparkSession, d: str) -> DataFrame:
    return sp.mass(lens.triples(spark, d)).select("gene_idx", "mechanism_idx", sp.param_index("gene_idx", "mechanism_idx", 10).alias("param_idx"), F.round("mass", 6).alias("mass"))


def row_and_column_mass(spark: SparkSession, d: str) -> DataFrame:
    """Sums of the coefficient table by gene and by mechanism."""
    b = coefficients(lens.triples(spark, d))
    g = b.groupBy(F.lit("gene").alias("axis"), F.col("gene_idx").alias("idx")).agg(F.sum("coef").alias("total"))
    m = b.groupBy(F.lit("mechanism").alias("axis"), F.col("mechanism_idx").alias("idx")).agg(F.sum("coef").alias("total"))
    return g.union(m).select("axis", "idx", F.round("total", 6).alias("total"))


def context_contributions(spark: SparkSession, d: str) -> DataFrame:
    t = lens.triples(spark, d)
    cm = sp.context_scores(t, "binary").groupBy("mechanism_idx").agg(F.sum("value").alias("annotation_count"))
    c = sp.context_contributions(sp.mass(t), coefficients(t), cm, effects(spark))
    return c.select("mechanism_idx", "annotation_count", *[F.round(x, 6).alias(x) for x in ("global_h2", "deviation_h2", "total_h2", "fraction")])


def gene_contribution_rank(spark: SparkSession, d: str) -> DataFrame:
    """The 25 genes of each context that contribute most."""
    t = lens.triples(spark, d)
    c = sp.mass(t).join(coefficients(t), ["gene_idx", "mechanism_idx"]).withColumn("contribution", F.round(F.col("mass") * F.col("coef"), 6))
    w = W.partitionBy("mechanism_idx").orderBy(F.col("contribution").desc(), "gene_idx")
    return c.withColumn("rank", F.row_number().over(w)).where("rank <= 25").select("mechanism_idx", "gene_idx", "rank", "contribution")


def cumulative_share_cut(spark: SparkSession, d: str) -> DataFrame:
    """Of each source's global ranking the fewest genes that hold half of the positive score."""
    s = F.col("score")
    r = table(spark, d, "rankings").where((F.col("analysis") == "global") & F.col("ensembl").isNotNull() & (s > 0) & (s < float("inf")) & ~F.isnan(s))
    g = r.groupBy("source", S.strip_version("ensembl").alias("ensembl")).agg(F.max("score").alias("score"))
    order = [F.col("score").desc(), F.col("ensembl").asc()]
    x = running_sum(g.withColumn("one", F.lit(1).cast("long")), ["source"], order, "score", "run")
    x = running_sum(x, ["source"], order, "one", "rank").join(g.groupBy("source").agg(F.sum("score").alias("whole")), "source")
    return x.where(F.round(F.col("run") - F.col("score"), 6) < F.round(0.5 * F.col("whole"), 6)).select("source", "ensembl", F.col("rank").cast("int").alias("rank"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """``source, analysis, ensembl, score``: each gene's highest finite score in a ranking."""
    s = F.col("score")
    r = table(spark, d, "rankings").where(F.col("ensembl").isNotNull() & (F.abs(s) < float("inf")) & ~F.isnan(s))
    return r.groupBy("source", "analysis", S.strip_version("ensembl").alias("ensembl")).agg(F.max("score").alias("score"))


def first_ranks(genes: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of each ranking; map tasks cut their rows to ``n`` a group before the shuffle."""
    w = W.partitionBy("source", "analysis").orderBy(F.col("score").desc(), "ensembl")
    return genes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def target_overlap_topk(spark: SparkSession, d: str) -> DataFrame:
    """Targets (genes with a name divisible by 7) among each ranking's first 100, with the hypergeometric tail."""
    r = scored(spark, d).withColumn("target", (F.substring("ensembl", -6, 6).try_cast("long") % 7 == 0).cast("int"))
    g = r.groupBy("source", "analysis").agg(F.count(F.lit(1)).alias("n_genes"), F.sum("target").alias("n_targets"))
    top = first_ranks(r, 100).groupBy("source", "analysis").agg(F.sum("target").alias("hits"), F.count(F.lit(1)).alias("n_top"))
    g = g.join(top, ["source", "analysis"])
    expected = F.col("n_top") * F.col("n_targets") / F.col("n_genes")
    p = S.hypergeom_p(F.col("hits"), F.col("n_genes"), F.col("n_targets"), F.col("n_top"))
    return g.select("source", "analysis", "n_genes", "n_targets", "n_top", "hits", F.round(expected, 6).alias("expected"), F.round(F.try_divide(F.col("hits").cast("double"), expected), 6).alias("fold"), F.round(p, 6).alias("p"))


def simulation_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Size, mean and sample deviation of each ranking's scores, in long form."""
    g = scored(spark, d).groupBy("source", "analysis").agg(F.count("score").cast("double").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"))
    return g.unpivot(["source", "analysis"], ["n", "mean", "sd"], "stat", "x").select("source", "analysis", "stat", (F.round("x", 9) + 0.0).alias("x"))


def run_report(spark: SparkSession, d: str) -> DataFrame:
    """Per source the leading context by score, its share, and whether it is the expected one."""
    g = scored(spark, d).where("analysis != 'global'").groupBy("source", "analysis").agg(F.sum(F.greatest("score", F.lit(0.0))).alias("total"))
    g = g.withColumn("total", F.round("total", 6))
    x = g.groupBy("source").agg(F.max_by("analysis", F.struct("total", "analysis")).alias("leading_context"), F.max("total").alias("lead"), F.sum("total").alias("whole"))
    return x.select("source", "leading_context", F.round(F.when(F.col("whole") > 0, F.col("lead") / F.col("whole")), 6).alias("leading_fraction"), (F.col("leading_context") == "microglia").alias("expected_leads"))


def best_lambda(spark: SparkSession, d: str) -> DataFrame:
    """Mean score of each penalty over folds, and the best one: folds from the stored cache, penalties from mechanisms."""
    t = lens.triples(spark, d).join(_folds(spark, d), "variant_idx").groupBy("fold", "mechanism_idx").agg(F.avg("value").alias("score"))
    m = t.groupBy("mechanism_idx").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n_folds"))
    best = m.agg(F.min_by("mechanism_idx", F.struct(F.round("score", 9), "mechanism_idx")).alias("b")).withColumn("_one", F.lit(1))
    return m.withColumn("_one", F.lit(1)).join(F.broadcast(best), "_one").select("mechanism_idx", F.round("score", 6).alias("score"), "n_folds", (F.col("mechanism_idx") == F.col("b")).alias("is_best"))


def score_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Pearson correlation of score and coefficient in each source; null where one of them does not vary."""
    s = F.col("score")
    r = table(spark, d, "rankings").where((F.abs(s) < float("inf")) & ~F.isnan(s))
    # the built-in corr fails where one side does not vary
    c = F.try_divide(F.covar_pop("score", "coefficient"), F.stddev_pop("score") * F.stddev_pop("coefficient"))
    return r.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(c, 6).alias("r"), F.count_distinct("ensembl").alias("n_genes"))


# --- the LD matrix ---


def ld_edges(spark: SparkSession, d: str) -> DataFrame:
    return lens.matrix(spark, d)


def identity_edges(spark: SparkSession, d: str) -> DataFrame:
    """Stored pairs in both directions with the diagonals that are stored; variants without one get an edge of one to themselves."""
    pairs = sp.ld_pairs(table(spark, d, "ld_blocks"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("row_idx"), F.col("b").alias("col_idx")), F.struct(F.col("b").alias("row_idx"), F.col("a").alias("col_idx")))).alias("e"), "r2").select("e.*", "r2")
    own = table(spark, d, "ld_blocks").where("row_idx = col_idx and r2 > 0 and r2 <= 1").groupBy("row_idx", "col_idx").agg(F.max("r2").alias("r2"))
    return antijoin_identity(both.unionByName(own), table(spark, d, "variants").select("variant_idx").distinct())


def ld_score(spark: SparkSession, d: str) -> DataFrame:
    return sp.ld_score(lens.matrix(spark, d)).select(F.col("row_idx").alias("variant_idx"), F.round("ld_score", 6).alias("ld_score"))


def ld_block_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Per region: variants with annotations, those with pairs, stored pairs, and whether the region lacks its diagonal."""
    e = sp.ld_pairs(table(spark, d, "ld_blocks"))
    ids = e.select("chrom", "region", F.explode(F.array("a", "b")).alias("variant_idx")).distinct()
    ann = lens.triples(spark, d).select("variant_idx").distinct().withColumn("ann", F.lit(1))
    m = ids.join(ann, "variant_idx", "left").groupBy("chrom", "region").agg(F.count(F.lit(1)).alias("matched"), F.count("ann").alias("annotated"))
    diag = table(spark, d, "ld_blocks").groupBy("chrom", "region").agg(F.count_if(F.col("row_idx") == F.col("col_idx")).alias("n_diagonal"))
    n = e.groupBy("chrom", "region").agg(F.count(F.lit(1)).alias("n_pairs"))
    return m.join(n, ["chrom", "region"]).join(diag, ["chrom", "region"], "left").select("chrom", "region", "matched", "annotated", "n_pairs", "n_diagonal")


def ld_annotation_score(spark: SparkSession, d: str) -> DataFrame:
    s = sp.context_scores(lens.triples(spark, d))
    x = sp.spmv(lens.matrix(spark, d), s.select("variant_idx", "mechanism_idx", "value"), extra=["mechanism_idx"])
    return x.select(F.col("row_idx").alias("variant_idx"), "mechanism_idx", F.round("value", 10).alias("value"))


def ld_score_totals(spark: SparkSession, d: str) -> DataFrame:
    """Sums of the context scores over all variants and over those with common pairs (r2 >= 0.05)."""
    s = sp.context_scores(lens.triples(spark, d))
    e = sp.ld_pairs(table(spark, d, "ld_blocks"), 0.05)
    common = e.select(F.explode(F.array("a", "b")).alias("variant_idx")).distinct().withColumn("common", F.lit(True))
    g = s.join(common, "variant_idx", "left").groupBy("mechanism_idx")
    return g.agg(F.round(F.sum("value"), 6).alias("m"), F.round(F.sum(F.when(F.col("common"), F.col("value")).otherwise(0.0)), 6).alias("m_common"))


def ld_propagate(spark: SparkSession, d: str) -> DataFrame:
    v = lens.triples(spark, d).groupBy("variant_idx").agg(F.sum("value").alias("value"))
    return sp.spmv(lens.matrix(spark, d), v).select(F.col("row_idx").alias("variant_idx"), F.round("value", 10).alias("value"))


N, TAU = 50_000, 1e-7


def mediated_prediction(spark: SparkSession, d: str) -> DataFrame:
    """1 + N (R2 A b + tau R2 1) for every variant."""
    t, m = lens.triples(spark, d), lens.matrix(spark, d)
    s = sp.spmv(m, sp.mediated(t, coefficients(t)), out="smoothed")
    x = sp.ld_score(m).join(s, "row_idx", "left")
    pred = 1 + N * (F.coalesce("smoothed", F.lit(0.0)) / 1000 + TAU * F.col("ld_score"))
    return x.select(F.col("row_idx").alias("variant_idx"), F.round(pred, 11).alias("prediction"))


def ld_components(spark: SparkSession, d: str) -> DataFrame:
    e = sp.ld_pairs(table(spark, d, "ld_blocks"), 0.1)
    return graph.region_components(e, ["chrom", "region"], "a", "b").select("chrom", "region", F.col("id").alias("variant_idx"), "component")


def ld_component_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Size summary per chromosome and over all (chromosome 0)."""
    s = ld_components(spark, d).groupBy("chrom", "region", "component").agg(F.count(F.lit(1)).alias("size"))
    both = s.select(F.explode(F.array(F.col("chrom"), F.lit(0))).alias("chrom"), "size")
    return graph.size_summary(both, ["chrom"])


def ld_size_hist(spark: SparkSession, d: str) -> DataFrame:
    s = ld_components(spark, d).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return s.groupBy(S.log2_bin("size").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("n_variants")).select(S.bin_label("bin").alias("size_range"), "n", "n_variants")


def component_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Components with an edge, their vertices and the edges at each threshold."""
    p = sp.ld_pairs(table(spark, d, "ld_blocks"))
    c = graph.sweep(p, THRESHOLDS, ["chrom", "region"]).groupBy("threshold", "component").agg(F.count(F.lit(1)).alias("size"))
    c = c.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_components"), F.sum("size").alias("n_vertices"), F.max("size").alias("largest"))
    e = p.select(F.explode(F.array_compact(F.array(*[F.when(F.col("r2") >= t, F.lit(t)) for t in THRESHOLDS]))).alias("threshold")).groupBy("threshold").agg(F.count(F.lit(1)).alias("n_edges"))
    return c.join(e, "threshold")


def _folds(spark: SparkSession, d: str) -> DataFrame:
    """One stored fold per variant: the lowest that is not null."""
    return table(spark, d, "cv_folds").where("cv_groups is not null").groupBy("variant_idx").agg(F.min("cv_groups").alias("fold"))


def fold_rows(spark: SparkSession, d: str) -> DataFrame:
    """Greedy gene-aware folds of whole components: rows and genes of each fold."""
    ids = table(spark, d, "variants").select("variant_idx").distinct()
    c = ld_components(spark, d).select("variant_idx", "component")
    members = ids.join(c, "variant_idx", "left").select("variant_idx", F.coalesce("component", "variant_idx").alias("component"))
    links = lens.triples(spark, d).select("variant_idx", "gene_idx").distinct()
    f = members.join(folding.assign_folds(members, links, 10), "component").select("variant_idx", "fold")
    s = folding.score_rows(f, links)
    return s.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("score_group") >= 0).alias("n_score_rows"))


def score_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Score groups by the rule, for the stored folds."""
    links = lens.triples(spark, d).select("variant_idx", "gene_idx")
    return folding.score_rows(_folds(spark, d), links)


def ld_universe_restrict(spark: SparkSession, d: str) -> DataFrame:
    """Variants with LD rows, numbered anew in order, with their former index."""
    from ..operators.index import dense_index

    v = lens.gwas(spark, d).select("variant_idx", "chrom", "pos")
    has = table(spark, d, "ld_blocks").select(F.explode(F.array("row_idx", "col_idx")).alias("variant_idx")).distinct()
    kept = v.join(has, "variant_idx", "left_semi").withColumnRenamed("variant_idx", "source_variant_idx")
    return dense_index(kept, [F.col("chrom"), F.col("pos"), F.col("source_variant_idx")], "variant_idx").select("variant_idx", "source_variant_idx")


def checkpoint_merge(spark: SparkSession, d: str) -> DataFrame:
    """Scores of every fold and context, kept in two shards of folds and merged: their mean over the folds."""
    n = lens.triples(spark, d).join(_folds(spark, d), "variant_idx").groupBy("fold", "mechanism_idx").agg(F.count(F.lit(1)).alias("n")).collect()  # folds x contexts
    got = {(r["fold"], r["mechanism_idx"]): float(r["n"]) for r in n}
    scratch = Scratch(spark, "shards")
    shards = {f"{scratch.root}/{k}": folds for k, folds in enumerate((range(5), range(5, 10)))}
    for folder, folds in shards.items():
        store = CheckpointStore(folder, {"contexts": CONTEXTS})
        for f in folds:
            for c in CONTEXTS:
                store.put(f, float(c), Fit("nuclear", np.zeros((1, 1)), 0.0), got.get((f, c), 0.0))
    merged = merge_stores(list(shards), list(range(10)), [float(c) for c in CONTEXTS])
    scratch.remove()
    return spark.createDataFrame([(int(c), round(v, 6)) for c, v in merged.items()], "mechanism_idx long, score double")


def fold_check(spark: SparkSession, d: str) -> DataFrame:
    """What the greedy folds must keep: all rows and components, none of them parted, every fold in use, and score groups by the rule."""
    ids = table(spark, d, "variants").select("variant_idx").distinct()
    c = ld_components(spark, d).select("variant_idx", "component")
    members = ids.join(c, "variant_idx", "left").select("variant_idx", F.coalesce("component", "variant_idx").alias("component"))
    links = lens.triples(spark, d).select("variant_idx", "gene_idx").distinct()
    f = members.join(folding.assign_folds(members, links, 10), "component")
    whole = f.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fold").alias("folds"))
    a = whole.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_components"), F.count_if(F.col("folds") > 1).alias("n_parted"))
    b = f.agg(F.countDistinct("fold").alias("n_folds"))
    return a.join(F.broadcast(b), F.lit(True))  # one row each


def row_compatibility(spark: SparkSession, d: str) -> DataFrame:
    """Whether the stored matrix rows of each chromosome equal the variants' rows, both ways."""
    v = lens.gwas(spark, d).select("chrom", "variant_idx")
    m = table(spark, d, "ld_blocks").select("chrom", F.explode(F.array("row_idx", "col_idx")).alias("variant_idx")).distinct()
    a = v.exceptAll(m).groupBy("chrom").agg(F.count(F.lit(1)).alias("missing"))
    b = m.exceptAll(v).groupBy("chrom").agg(F.count(F.lit(1)).alias("extra"))
    base = v.select("chrom").distinct()
    return base.join(a, "chrom", "left").join(b, "chrom", "left").na.fill(0, ["missing", "extra"]).withColumn("equal", F.col("missing") + F.col("extra") == 0)


QUERIES = {f.__name__: f for f in (
    predicted_links_sum_pivot, context_aggregate_sum, context_aggregate_binary, annotation_mass, row_and_column_mass, context_contributions,
    gene_contribution_rank, cumulative_share_cut, target_overlap_topk, simulation_aggregate, run_report, best_lambda, score_correlation,
    ld_edges, identity_edges, ld_score, ld_block_diagnostics, ld_annotation_score, ld_score_totals, ld_propagate, mediated_prediction, ld_components,
    ld_component_sizes, ld_size_hist, component_sweep, fold_rows, fold_check, score_eligibility, ld_universe_restrict, checkpoint_merge, row_compatibility,
)}

_B = "b AS (SELECT DISTINCT gene_idx, mechanism_idx, ((gene_idx * 7 + mechanism_idx * 3) % 11) / 100 AS coef FROM a)"
_RANKED = """WITH r AS (SELECT source, analysis, split_part(ensembl, '.', 1) AS ensembl, max(score) AS score FROM rankings WHERE ensembl IS NOT NULL AND isfinite(score) GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY source, analysis ORDER BY score DESC, ensembl) AS rank FROM r)"""
_FOLDS = "f AS (SELECT variant_idx, min(cv_groups) AS fold FROM cv_folds WHERE cv_groups IS NOT NULL GROUP BY 1)"


def _components(cut: str) -> str:
    """Reachability by recursion; labels are the smallest vertex."""
    return f"""
  e AS (SELECT DISTINCT chrom, region, least(row_idx, col_idx) AS a, greatest(row_idx, col_idx) AS b FROM ld_blocks WHERE isfinite(r2) AND r2 >= {cut} AND r2 <= 1 AND row_idx <> col_idx),
  s AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e),
  reach AS (SELECT DISTINCT x, x AS y FROM s UNION SELECT reach.x, s.y FROM reach JOIN s ON reach.y = s.x),
  lab AS (SELECT x AS variant_idx, min(y) AS component FROM reach GROUP BY 1),
  where_ AS (SELECT DISTINCT chrom, region, unnest([a, b]) AS variant_idx FROM e)"""


ORACLES = {
    "predicted_links_sum_pivot": ctes("a")
    + " SELECT variant_idx, "
    + ", ".join(f"round(coalesce(sum(value) FILTER (WHERE mechanism_idx = {c}), 0), 6) AS m{c}" for c in CONTEXTS)
    + " FROM (SELECT DISTINCT variant_idx FROM variants) LEFT JOIN a USING (variant_idx) GROUP BY 1",
    "context_aggregate_sum": ctes("a") + " SELECT variant_idx, mechanism_idx, round(sum(value), 6) AS value FROM a GROUP BY 1, 2",
    "context_aggregate_binary": ctes("a") + " SELECT variant_idx, mechanism_idx, CAST(sum(value) > 0 AS DOUBLE) AS value FROM a WHERE mechanism_idx <> 0 GROUP BY 1, 2",
    "annotation_mass": ctes("a") + " SELECT gene_idx, mechanism_idx, gene_idx * 10 + mechanism_idx AS param_idx, round(sum(value), 6) AS mass FROM a GROUP BY 1, 2",
    "row_and_column_mass": ctes("a") + f", {_B} SELECT 'gene' AS axis, gene_idx AS idx, round(sum(coef), 6) AS total FROM b GROUP BY 2 UNION ALL SELECT 'mechanism', mechanism_idx, round(sum(coef), 6) FROM b GROUP BY 2",
    "context_contributions": ctes("a")
    + f""", {_B}, ms AS (SELECT gene_idx, mechanism_idx, sum(value) AS mass FROM a GROUP BY 1, 2),
      dv AS (SELECT mechanism_idx, sum(mass * coef) AS deviation_h2 FROM ms JOIN b USING (gene_idx, mechanism_idx) GROUP BY 1),
      cs AS (SELECT variant_idx, mechanism_idx, CAST(sum(value) > 0 AS DOUBLE) AS v FROM a GROUP BY 1, 2),
      cm AS (SELECT mechanism_idx, sum(v) AS annotation_count, sum(v) * mechanism_idx / 50 AS global_h2 FROM cs GROUP BY 1),
      x AS (SELECT cm.*, coalesce(deviation_h2, 0) AS deviation_h2, global_h2 + coalesce(deviation_h2, 0) AS total_h2 FROM cm LEFT JOIN dv USING (mechanism_idx))
      SELECT mechanism_idx, annotation_count, round(global_h2, 6) AS global_h2, round(deviation_h2, 6) AS deviation_h2, round(total_h2, 6) AS total_h2,
        round(CASE WHEN sum(total_h2) OVER () > 0 THEN total_h2 / sum(total_h2) OVER () ELSE 0 END, 6) AS fraction FROM x""",
    "gene_contribution_rank": ctes("a")
    + f""", {_B}, x AS (SELECT mechanism_idx, gene_idx, round(sum(value) * min(coef), 6) AS contribution FROM a JOIN b USING (gene_idx, mechanism_idx) GROUP BY 1, 2)
      SELECT * FROM (SELECT mechanism_idx, gene_idx, CAST(row_number() OVER (PARTITION BY mechanism_idx ORDER BY contribution DESC, gene_idx) AS INT) AS rank, contribution FROM x) WHERE rank <= 25""",
    "cumulative_share_cut": """WITH g AS (SELECT source, split_part(ensembl, '.', 1) AS ensembl, max(score) AS score FROM rankings WHERE analysis = 'global' AND ensembl IS NOT NULL AND score > 0 AND isfinite(score) GROUP BY ALL),
      x AS (SELECT *, sum(score) OVER (PARTITION BY source ORDER BY score DESC, ensembl ROWS UNBOUNDED PRECEDING) AS run, sum(score) OVER (PARTITION BY source) AS whole,
        CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, ensembl) AS INT) AS rank FROM g)
      SELECT source, ensembl, rank FROM x WHERE round(run - score, 6) < round(0.5 * whole, 6)""",
    "target_overlap_topk": _RANKED
    + """, t AS (SELECT *, CASE WHEN CAST(right(ensembl, 6) AS BIGINT) % 7 = 0 THEN 1 ELSE 0 END AS target FROM k),
      g AS (SELECT source, analysis, count(*) AS n_genes, CAST(sum(target) AS BIGINT) AS n_targets, CAST(coalesce(sum(target) FILTER (WHERE rank <= 100), 0) AS BIGINT) AS hits, count(*) FILTER (WHERE rank <= 100) AS n_top FROM t GROUP BY ALL)
      SELECT source, analysis, n_genes, n_targets, n_top, hits, round(n_top * n_targets / n_genes, 6) AS expected,
        round(CASE WHEN n_targets > 0 THEN hits / (n_top * n_targets / n_genes) END, 6) AS fold,
        round(CASE WHEN hits <= greatest(0, n_top + n_targets - n_genes) THEN 1.0 ELSE list_sum(list_transform(range(hits, least(n_targets, n_top) + 1), lambda x: exp(
          lgamma(n_targets + 1) - lgamma(x + 1) - lgamma(n_targets - x + 1) + lgamma(n_genes - n_targets + 1) - lgamma(n_top - x + 1) - lgamma(n_genes - n_targets - n_top + x + 1)
          - lgamma(n_genes + 1) + lgamma(n_top + 1) + lgamma(n_genes - n_top + 1)))) END, 6) AS p FROM g""",
    "simulation_aggregate": _RANKED
    + """, g AS (SELECT source, analysis, count(score) AS n, avg(score) AS mean, stddev_samp(score) AS sd FROM k GROUP BY ALL)
      SELECT source, analysis, 'n' AS stat, CAST(n AS DOUBLE) AS x FROM g UNION ALL SELECT source, analysis, 'mean', round(mean, 9) + 0.0 FROM g UNION ALL SELECT source, analysis, 'sd', round(sd, 9) FROM g""",
    "run_report": _RANKED
    + """, g AS (SELECT source, analysis, round(sum(greatest(score, 0.0)), 6) AS total FROM k WHERE analysis <> 'global' GROUP BY ALL)
      SELECT source, max_by(analysis, row(total, analysis)) AS leading_context, round(CASE WHEN sum(total) > 0 THEN max(total) / sum(total) END, 6) AS leading_fraction,
        max_by(analysis, row(total, analysis)) = 'microglia' AS expected_leads FROM g GROUP BY 1""",
    "best_lambda": ctes("a")
    + f""", {_FOLDS}, t AS (SELECT fold, mechanism_idx, avg(value) AS score FROM a JOIN f USING (variant_idx) GROUP BY 1, 2),
      m AS (SELECT mechanism_idx, avg(score) AS score, count(*) AS n_folds FROM t GROUP BY 1)
      SELECT mechanism_idx, round(score, 6) AS score, n_folds, mechanism_idx = first_value(mechanism_idx) OVER (ORDER BY round(score, 9), mechanism_idx) AS is_best FROM m""",
    "score_correlation": """WITH x AS (SELECT source, count(*) AS n, corr(score, coefficient) AS r, count(DISTINCT ensembl) AS n_genes FROM rankings WHERE isfinite(score) GROUP BY 1)
      SELECT source, n, round(CASE WHEN NOT isnan(r) THEN r END, 6) AS r, n_genes FROM x""",
    "ld_edges": ctes("ld") + " SELECT row_idx, col_idx, r2 FROM ld",
    "identity_edges": ctes("ld")
    + """, o AS (SELECT row_idx, max(r2) AS r2 FROM ld_blocks WHERE row_idx = col_idx AND r2 > 0 AND r2 <= 1 GROUP BY 1)
      SELECT row_idx, col_idx, r2 FROM ld WHERE row_idx <> col_idx UNION ALL SELECT row_idx, row_idx, r2 FROM o
      UNION ALL SELECT variant_idx, variant_idx, 1.0 FROM (SELECT DISTINCT variant_idx FROM variants) WHERE variant_idx NOT IN (SELECT row_idx FROM o)""",
    "ld_score": ctes("ld") + " SELECT row_idx AS variant_idx, round(sum(r2), 6) AS ld_score FROM ld GROUP BY 1",
    "ld_block_diagnostics": ctes("a", "ld")
    + """, ids AS (SELECT DISTINCT chrom, region, unnest([a, b]) AS variant_idx FROM ldp), an AS (SELECT DISTINCT variant_idx, 1 AS ann FROM a),
      m AS (SELECT chrom, region, count(*) AS matched, count(ann) AS annotated FROM ids LEFT JOIN an USING (variant_idx) GROUP BY ALL),
      n AS (SELECT chrom, region, count(*) AS n_pairs FROM ldp GROUP BY ALL),
      dg AS (SELECT chrom, region, count(*) FILTER (WHERE row_idx = col_idx) AS n_diagonal FROM ld_blocks GROUP BY ALL)
      SELECT * FROM m JOIN n USING (chrom, region) LEFT JOIN dg USING (chrom, region)""",
    "ld_annotation_score": ctes("a", "ld") + ", s AS (SELECT variant_idx, mechanism_idx, sum(value) AS v FROM a GROUP BY 1, 2) SELECT row_idx AS variant_idx, mechanism_idx, round(sum(r2 * v), 10) AS value FROM ld JOIN s ON ld.col_idx = s.variant_idx GROUP BY 1, 2",
    "ld_score_totals": ctes("a", "ld")
    + """, s AS (SELECT variant_idx, mechanism_idx, sum(value) AS v FROM a GROUP BY 1, 2), c AS (SELECT DISTINCT unnest([a, b]) AS variant_idx FROM ldp WHERE r2 >= 0.05)
      SELECT mechanism_idx, round(sum(v), 6) AS m, round(coalesce(sum(v) FILTER (WHERE variant_idx IN (SELECT variant_idx FROM c)), 0), 6) AS m_common FROM s GROUP BY 1""",
    "ld_propagate": ctes("a", "ld") + ", s AS (SELECT variant_idx, sum(value) AS v FROM a GROUP BY 1) SELECT row_idx AS variant_idx, round(sum(r2 * v), 10) AS value FROM ld JOIN s ON ld.col_idx = s.variant_idx GROUP BY 1",
    "mediated_prediction": ctes("a", "ld")
    + f""", {_B}, m AS (SELECT variant_idx, sum(value * coef) AS v FROM a JOIN b USING (gene_idx, mechanism_idx) GROUP BY 1),
      s AS (SELECT row_idx, sum(r2 * v) AS smoothed FROM ld JOIN m ON ld.col_idx = m.variant_idx GROUP BY 1), l AS (SELECT row_idx, sum(r2) AS ld_score FROM ld GROUP BY 1)
      SELECT row_idx AS variant_idx, round(1 + 50000 * (coalesce(smoothed, 0) / 1000 + 1e-7 * ld_score), 11) AS prediction FROM l LEFT JOIN s USING (row_idx)""",
    "ld_components": "WITH RECURSIVE " + _components("0.1") + " SELECT chrom, region, variant_idx, component FROM lab JOIN where_ USING (variant_idx)",
    "ld_component_sizes": "WITH RECURSIVE "
    + _components("0.1")
    + """, z AS (SELECT chrom, region, component, count(*) AS size FROM lab JOIN where_ USING (variant_idx) GROUP BY ALL), y AS (SELECT unnest([chrom, 0]) AS chrom, size FROM z)
      SELECT CAST(chrom AS INT) AS chrom, count(*) AS n_components, count(*) FILTER (WHERE size = 1) AS n_singletons, max(size) AS largest,
        quantile_cont(size, 0.5) AS q50, quantile_cont(size, 0.9) AS q90, quantile_cont(size, 0.99) AS q99 FROM y GROUP BY 1""",
    "ld_size_hist": "WITH RECURSIVE "
    + _components("0.1")
    + """, z AS (SELECT component, count(*) AS size FROM lab GROUP BY ALL), y AS (SELECT CAST(floor(log2(size)) AS INT) AS b, count(*) AS n, CAST(sum(size) AS BIGINT) AS n_variants FROM z GROUP BY 1)
      SELECT CASE WHEN b = 0 THEN '1' ELSE CAST(pow(2, b) AS BIGINT) || '-' || (CAST(pow(2, b + 1) AS BIGINT) - 1) END AS size_range, n, n_variants FROM y""",
    "score_eligibility": ctes("a")
    + f""", {_FOLDS}, lf AS (SELECT DISTINCT variant_idx, gene_idx, fold FROM a JOIN f USING (variant_idx)),
      sh AS (SELECT gene_idx FROM lf GROUP BY 1 HAVING min(fold) < max(fold)), ok AS (SELECT DISTINCT variant_idx FROM lf WHERE gene_idx IN (SELECT gene_idx FROM sh))
      SELECT variant_idx, fold, CASE WHEN variant_idx IN (SELECT variant_idx FROM ok) THEN fold ELSE -1 END AS score_group FROM f""",
    "ld_universe_restrict": ctes("g")
    + """ SELECT row_number() OVER (ORDER BY chrom, pos, variant_idx) - 1 AS variant_idx, variant_idx AS source_variant_idx FROM g
      WHERE variant_idx IN (SELECT row_idx FROM ld_blocks UNION SELECT col_idx FROM ld_blocks)""",
    "checkpoint_merge": ctes("a")
    + f", {_FOLDS}, n AS (SELECT mechanism_idx, count(*) AS n FROM a JOIN f USING (variant_idx) GROUP BY 1) SELECT CAST(k AS BIGINT) AS mechanism_idx, round(coalesce(n, 0) / 10, 6) AS score FROM range(1, 10) t(k) LEFT JOIN n ON n.mechanism_idx = k",
    "fold_check": f"""WITH RECURSIVE {_components('0.1')}, v AS (SELECT DISTINCT variant_idx FROM variants)
      SELECT (SELECT count(*) FROM v) AS n_rows, (SELECT count(DISTINCT coalesce(lab.component, v.variant_idx)) FROM v LEFT JOIN lab USING (variant_idx)) AS n_components, CAST(0 AS BIGINT) AS n_parted, CAST(10 AS BIGINT) AS n_folds""",
    "row_compatibility": ctes("g")
    + """, v AS (SELECT chrom, variant_idx FROM g), m AS (SELECT DISTINCT chrom, unnest([row_idx, col_idx]) AS variant_idx FROM ld_blocks),
      a AS (SELECT chrom, count(*) AS missing FROM (SELECT * FROM v EXCEPT ALL SELECT * FROM m) GROUP BY 1), b AS (SELECT chrom, count(*) AS extra FROM (SELECT * FROM m EXCEPT ALL SELECT * FROM v) GROUP BY 1)
      SELECT chrom, coalesce(missing, 0) AS missing, coalesce(extra, 0) AS extra, coalesce(missing, 0) + coalesce(extra, 0) = 0 AS equal FROM (SELECT DISTINCT chrom FROM v) LEFT JOIN a USING (chrom) LEFT JOIN b USING (chrom)""",
}
_SWEEP = """SELECT {t} AS threshold, count(*) AS n_components, CAST(sum(size) AS BIGINT) AS n_vertices, max(size) AS largest, (SELECT count(*) FROM e) AS n_edges FROM (SELECT component, count(*) AS size FROM lab GROUP BY 1)"""
ORACLES["component_sweep"] = " UNION ALL ".join(f"(WITH RECURSIVE {_components(repr(t))} {_SWEEP.format(t=f'CAST({t} AS DOUBLE)')})" for t in THRESHOLDS)
