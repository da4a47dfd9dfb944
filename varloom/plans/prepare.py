"""Composite preparations: marker-ordered annotations, statistics on reference identifiers, lifted links, references, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import scalars as S
from ..operators import sparse as sp
from ..operators.joins import first_per, left_fill, range_join, unique_keys
from ..operators.liftover import lift
from ..session import table
from ..sources import sinks
from ..sources.results import read_context_effects  # noqa: F401
from . import lens
from .lens import ctes


def marker_annotations(bim: DataFrame, links: DataFrame, contexts: list[str], min_score: float = 0.015, exclude_self_promoter: bool = False, binary: bool = False) -> DataFrame:
    """``snp, contexts...``: per marker the sum over genes of each gene's best link, or 1 where there is any."""
    x = links.where((F.col("score") >= min_score) & F.col("cell_type").isin(contexts))
    if exclude_self_promoter:
        x = x.where(S.keeps_self_promoter("is_self_promoter"))
    hit = range_join(bim.select("snp", "chrom", "pos"), x, ["chrom"], "pos", "start", "end")
    best = hit.groupBy("snp", "gene", "cell_type").agg(F.max("score").alias("v"))
    wide = best.groupBy("snp").pivot("cell_type", contexts).agg(F.sum("v")).na.fill(0.0)
    return wide.select("snp", *[(F.col(c) > 0).cast("double").alias(c) for c in contexts]) if binary else wide


def marker_peaks(bim: DataFrame, peaks: DataFrame, contexts: list[str]) -> DataFrame:
    """``snp, contexts...`` as 0/1 for the markers inside a peak."""
    hit = range_join(bim.select("snp", "chrom", "pos"), peaks, ["chrom"], "pos", "start", "end")
    return hit.groupBy("snp").agg(*[F.max((F.col("context") == c).cast("double")).alias(c) for c in contexts])


def match_to_reference(gwas: DataFrame, bim: DataFrame | None, order: list[str]) -> DataFrame:
    """``SNP, N, Z`` of the autosomal rows with a z and a positive size; of a repeated SNP the first by ``order`` counts.

    With a reference its identifiers replace the rows' own, by coordinate, and coordinates that the
    reference repeats are left out; without one the rows' own ``snp`` is kept where it is not null.
    """
    g = gwas.where(F.col("chrom").between(1, 22) & F.col("z").isNotNull() & ~F.isnan("z") & (F.col("n") > 0) & ~F.isnan(F.col("n").cast("double")))
    at = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    if bim is None:
        j = g.where("snp is not null").select(F.col("snp").alias("SNP"), F.col("n").alias("N"), F.col("z").alias("Z"), *at)
    else:
        ref = unique_keys(bim.select(F.col("chrom").alias("_c"), F.col("pos").alias("_p"), F.col("snp").alias("SNP")), ["_c", "_p"])
        j = g.select("chrom", "pos", F.col("n").alias("N"), F.col("z").alias("Z"), *at).join(ref, (F.col("chrom") == F.col("_c")) & (F.col("pos") == F.col("_p")))
    first = j.groupBy("SNP").agg(F.min(F.struct(*[F.col(f"_o{i}") for i in range(len(order))], "N", "Z")).alias("_s"))
    return first.select("SNP", "_s.N", "_s.Z")


def prepare_predicted(links: DataFrame, blocks: DataFrame, min_score: float) -> DataFrame:
    """Lifted predicted links ``chrom, pos, gene, mechanism, score``: positions are lifted once each, then the best score of a key counts."""
    x = links.where(F.col("score") >= min_score)
    at = x.select("chrom", "pos").distinct().withColumn("k", F.concat_ws(":", F.col("chrom").cast("string"), F.col("pos").cast("string")))
    to = at.join(lift(at, blocks, "k"), "k").select("chrom", "pos", "to_chrom", "to_pos")
    y = x.join(to, ["chrom", "pos"])
    return y.groupBy(F.col("to_chrom").alias("chrom"), F.col("to_pos").alias("pos"), "gene", "mechanism").agg(F.max("score").alias("score"))


def reference_tables(matrix: DataFrame, scores: DataFrame, markers: DataFrame, contexts: list[int]) -> tuple[DataFrame, DataFrame]:
    """Annotations (base is one) and their LD scores for every marker; ``markers`` is ``variant_idx, CHR, SNP, BP``."""
    named = lambda v: [F.coalesce(F.col(str(c)), F.lit(0.0)).alias(f"L{c}") for c in contexts]
    own = scores.groupBy("variant_idx").pivot("mechanism_idx", contexts).agg(F.sum("value"))
    head = [F.col("variant_idx").alias("_row"), "CHR", "SNP", "BP"]
    annot = markers.join(own, "variant_idx", "left").select(*head, F.lit(1.0).alias("base"), *named(own))
    ld = sp.ld_score(matrix).withColumnRenamed("row_idx", "variant_idx").withColumnRenamed("ld_score", "base")
    x = sp.spmv(matrix, scores.select("variant_idx", "mechanism_idx", "value"), extra=["mechanism_idx"])
    wide = x.groupBy(F.col("row_idx").alias("variant_idx")).pivot("mechanism_idx", contexts).agg(F.sum("value"))
    return annot, markers.join(ld, "variant_idx").join(wide, "variant_idx", "left").select(*head, "base", *named(wide))


def write_reference(matrix: DataFrame, scores: DataFrame, markers: DataFrame, contexts: list[int], out: str) -> None:
    """LD-score reference of every marker in order: scores, annotations, weights and annotation sums."""
    sinks.write_ldsc_reference(*reference_tables(matrix, scores, markers, contexts), out)


def predicted_marker_scores(bim: DataFrame, links: DataFrame, contexts: list[str], min_score: float = 0.9) -> DataFrame:
    """``snp, contexts...``: per marker the sum over genes of the predicted links at its position."""
    x = links.where((F.col("score") >= min_score) & F.col("mechanism").isin(contexts))
    best = x.groupBy("chrom", "pos", "gene", "mechanism").agg(F.max("score").alias("v"))
    return bim.select("snp", "chrom", "pos").join(best, ["chrom", "pos"]).groupBy("snp").pivot("mechanism", contexts).agg(F.sum(F.col("v").cast("double"))).na.fill(0.0)


def build_baseline(kind: str, bim: DataFrame, source: DataFrame, contexts: list[str], out: str, min_score: float | None = None, blocks: DataFrame | None = None) -> None:
    """Annotation files of every marker of ``bim`` from one kind of source: ``links``, ``lifted_links`` (lifted through
    ``blocks`` first), ``peaks`` or ``predicted``."""
    if kind == "lifted_links":
        source, kind = lift_links(source, blocks)[0], "links"
    if kind == "links":
        scores = marker_annotations(bim, source, contexts, 0.015 if min_score is None else min_score)
    elif kind == "peaks":
        scores = marker_peaks(bim, source, contexts)
    elif kind == "predicted":
        scores = predicted_marker_scores(bim, source, contexts, 0.9 if min_score is None else min_score)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    sinks.write_annotations(bim, scores, contexts, out)


def lift_links(links: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links whose two ends lift to one chromosome in order, with their new bounds; and ``cell_type, input_rows, mapped_rows, unmapped_rows``.

    ``start`` and ``end`` are half-open, so the last base is lifted and the end is one behind it.
    """
    keyed = links.withColumn("_at", F.explode(F.array(F.col("start"), F.col("end") - 1)))
    at = keyed.select("chrom", F.col("_at").alias("pos")).distinct().withColumn("k", F.concat_ws(":", F.col("chrom").cast("string"), F.col("pos").cast("string")))
    to = at.join(lift(at, blocks, "k"), "k").select("chrom", "pos", "to_chrom", "to_pos")
    a = to.select("chrom", F.col("pos").alias("start"), F.col("to_chrom").alias("_c"), F.col("to_pos").alias("_a"))
    b = to.select("chrom", (F.col("pos") + 1).alias("end"), F.col("to_chrom").alias("_d"), F.col("to_pos").alias("_b"))
    both = links.join(a, ["chrom", "start"], "left").join(b, ["chrom", "end"], "left")
    ok = F.coalesce((F.col("_c") == F.col("_d")), F.lit(False))
    lo, hi = F.least("_a", "_b"), F.greatest("_a", "_b") + 1
    new = both.where(ok).withColumns({"chrom": F.col("_c"), "start": lo, "end": hi}).select(*links.columns)
    counts = both.groupBy("cell_type").agg(F.count(F.lit(1)).alias("input_rows"), F.count_if(ok).alias("mapped_rows"), F.count_if(~ok).alias("unmapped_rows"))
    return new, counts


def expressed_genes(links: DataFrame, blocks: DataFrame) -> DataFrame:
    """``chrom, tss, gene, cell_type`` of the genes that links (``chrom, gene, tss, expressed, cell_type``) call expressed, lifted, each once."""
    x = links.where((F.lower(F.col("expressed").cast("string")) == "true") & (F.col("tss") > 0) & F.col("chrom").isNotNull() & F.col("gene").isNotNull())
    x = x.select("chrom", "tss", "gene", "cell_type").distinct()
    at = x.select("chrom", (F.col("tss") - 1).alias("pos")).distinct().withColumn("k", F.concat_ws(":", F.col("chrom").cast("string"), F.col("pos").cast("string")))
    to = at.join(lift(at, blocks, "k"), "k").select("chrom", (F.col("pos") + 1).alias("tss"), "to_chrom", (F.col("to_pos") + 1).alias("to_tss"))
    return x.join(to, ["chrom", "tss"]).select(F.col("to_chrom").alias("chrom"), F.col("to_tss").alias("tss"), "gene", "cell_type").distinct()


def snp_identity(variants: DataFrame, meta: DataFrame) -> DataFrame:
    """``variant_idx, SNP, A1, A2, CHR, BP`` from LD metadata: by marker name, else by coordinate; a variant without any is an error.

    Of several metadata rows that match a variant the first by ``ld_row`` counts.
    """
    m = meta.select(F.col("snp").alias("SNP"), F.col("a1").alias("A1"), F.col("a2").alias("A2"), F.col("variant_id").alias("_vid"), "chrom", "ld_row")
    v = variants.select("variant_idx", "marker", "variant_id", "chrom", "pos")
    by_name = m.join(v.select(F.col("marker").alias("SNP"), "chrom", F.col("variant_idx").alias("_n")), ["SNP", "chrom"], "left")
    hit = by_name.join(v.select(F.col("variant_id").alias("_vid"), F.col("variant_idx").alias("_p")), "_vid", "left").withColumn("variant_idx", F.coalesce("_n", "_p")).where("variant_idx is not null")
    first = first_per(hit.select("variant_idx", "ld_row", "SNP", "A1", "A2"), ["variant_idx"], [F.col("ld_row"), F.col("SNP")])
    if not v.join(first, "variant_idx", "left_anti").isEmpty():
        raise ValueError("variants without a name in the metadata")
    return v.join(first, "variant_idx").select("variant_idx", "SNP", "A1", "A2", F.col("chrom").alias("CHR"), F.col("pos").alias("BP"))


def reindex_coefficients(coef: DataFrame, genes: DataFrame, mechanisms: list[int]) -> DataFrame:
    """``gene_idx, mechanism_idx, coef`` for every gene and mechanism, zero where there is none; an unknown mechanism is an error."""
    if unknown := sorted({r[0] for r in coef.select("mechanism_idx").distinct().collect()} - set(mechanisms)):
        raise ValueError(f"unknown mechanisms: {unknown}")
    full = genes.select("gene_idx", F.explode(F.array(*[F.lit(m).cast("long") for m in mechanisms])).alias("mechanism_idx"))
    return left_fill(full, coef, ["gene_idx", "mechanism_idx"], {"coef": 0.0})


def enrich(ranked: DataFrame, first: DataFrame, sets: DataFrame, groups: list[str], alpha: float = 0.05) -> DataFrame:
    """Over-representation of gene sets (``set_name, ensembl``) among the ``first`` genes of each ranking.

    ``groups..., set_name, n_genes, n_set, n_top, hits, p`` of the sets with a hit and p below ``alpha``;
    the population is the ranking itself.
    """
    s = sets.distinct()
    size = ranked.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_genes")).join(first.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_top")), groups)
    n_set = ranked.join(s, "ensembl").groupBy(*groups, "set_name").agg(F.count(F.lit(1)).alias("n_set"))
    hits = first.join(s, "ensembl").groupBy(*groups, "set_name").agg(F.count(F.lit(1)).alias("hits"))
    x = hits.join(n_set, [*groups, "set_name"]).join(size, groups)
    x = x.withColumn("p", S.hypergeom_p(F.col("hits"), F.col("n_genes"), F.col("n_set"), F.col("n_top")))
    return x.where(F.col("p") < alpha).select(*groups, "set_name", "n_genes", "n_set", "n_top", "hits", "p")


def write_fit(spark: SparkSession, path: str, fit, genes: list[str], contexts: list[str], info: dict, contributions: DataFrame | None = None, diagnostics: DataFrame | None = None) -> None:
    """Coefficients, context effects, contributions and LD diagnostics as Parquet, and the run's metadata as JSON, in one folder."""
    rows = [(g, c, float(fit.b[i, j])) for i, g in enumerate(genes) for j, c in enumerate(contexts)]
    spark.createDataFrame(rows, "gene string, mechanism string, coef double").write.mode("overwrite").parquet(f"{path}/coefficients")
    if fit.effects is not None:
        se = fit.effects_se if fit.effects_se is not None else [None] * len(contexts)
        ef = [(c, float(e), None if s is None else float(s)) for c, e, s in zip(contexts, fit.effects, se)]
        spark.createDataFrame(ef, "context string, effect double, standard_error double").write.mode("overwrite").parquet(f"{path}/context_effects")
    for name, df in (("context_contributions", contributions), ("ld_diagnostics", diagnostics)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
    sinks.write_json(f"{path}/metadata.json", {"method": fit.method, "tau": fit.tau, "losses": fit.losses, **fit.info, **info})


# --- queries ---

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _bim(spark: SparkSession, d: str) -> DataFrame:
    return lens.variants(spark, d).select(F.col("marker").alias("snp"), "chrom", "pos")


def marker_link_annotation(spark: SparkSession, d: str) -> DataFrame:
    """Every marker with the sum over genes of its best link in each cell type, without self-promoters."""
    a = marker_annotations(_bim(spark, d), lens.links(spark, d), ["A", "N", "R"], exclude_self_promoter=True)
    out = left_fill(_bim(spark, d).select("snp"), a, ["snp"], {"A": 0.0, "N": 0.0, "R": 0.0})
    return out.select("snp", *[F.round(c, 6).alias(c) for c in ("A", "N", "R")])


def marker_peak_annotation(spark: SparkSession, d: str) -> DataFrame:
    a = marker_peaks(_bim(spark, d), lens.peaks(spark, d), PRIORITIES)
    return a.select("snp", *[F.col(f"`{c}`").alias(f"p{c[0]}") for c in PRIORITIES])


def reference_sumstats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the variants under the reference's identifiers (the same table): coordinates that occur twice drop out."""
    v = lens.variants(spark, d)
    return match_to_reference(v.withColumn("n", F.col("event_id") % 1000), v.select("chrom", "pos", F.col("marker").alias("snp")), ["event_id"]).select("SNP", "N", F.round("Z", 6).alias("Z"))


def own_sumstats(spark: SparkSession, d: str) -> DataFrame:
    """The same without a reference: markers as they are, the first row of each by time of loading."""
    v = table(spark, d, "variants").select("chrom", "pos", F.col("markerid").alias("snp"), "z", "n", "loaded_at", "variant_idx")
    v = v.where(F.abs("z") < float("inf"))
    return match_to_reference(v, None, ["loaded_at", "variant_idx", "z", "n"]).select("SNP", "N", F.round("Z", 6).alias("Z"))


def predicted_lifted(spark: SparkSession, d: str) -> DataFrame:
    """Link starts as predictions, lifted through the blocks of the liftover query."""
    blocks = first_per(lens.peaks(spark, d).select("chrom", "start", "end").distinct(), ["chrom", "start"], [F.col("end")])
    blocks = blocks.select("chrom", "start", "end", F.col("chrom").alias("to_chrom"), (F.col("start") + 1000).alias("to_start"), F.lit(True).alias("forward"))
    x = lens.links(spark, d).select("chrom", F.col("start").alias("pos"), "gene", F.col("cell_type").alias("mechanism"), "score")
    return prepare_predicted(x, blocks, 0.03)


def coefficients_reindexed(spark: SparkSession, d: str) -> DataFrame:
    t = lens.triples(spark, d)
    coef = sp.mass(t).where("mass >= 1").select("gene_idx", "mechanism_idx", F.round("mass", 6).alias("coef"))
    return reindex_coefficients(coef, t.select("gene_idx").distinct(), list(range(10)))


def normalized_context_mass(spark: SparkSession, d: str) -> DataFrame:
    m = sp.mass(lens.triples(spark, d)).groupBy("mechanism_idx").agg(F.sum("mass").alias("m"))
    return m.select("mechanism_idx", F.round(F.col("m") / F.sum("m").over(W.partitionBy()), 6).alias("share"))


def set_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Gene sets by the identifier's remainder of 40, over the first 100 of each ranking."""
    from .matrices import first_ranks, scored

    r = scored(spark, d)
    sets = r.select((F.substring("ensembl", -6, 6).try_cast("long") % 40).cast("string").alias("set_name"), "ensembl").distinct()
    e = enrich(r, first_ranks(r, 100), sets, ["source", "analysis"])
    return e.withColumn("p", F.round("p", 6))


QUERIES = {f.__name__: f for f in (marker_link_annotation, marker_peak_annotation, reference_sumstats, own_sumstats, predicted_lifted, coefficients_reindexed, normalized_context_mass, set_enrichment)}

ORACLES = {
    "marker_link_annotation": ctes("vv", "l")
    + """, h AS (SELECT v.marker AS snp, gene, cell_type, max(score) AS s FROM v JOIN l ON v.chrom = l.chrom AND v.pos BETWEEN l.s AND l.e WHERE score >= 0.015 AND NOT is_self_promoter GROUP BY ALL)
      SELECT v.marker AS snp, round(coalesce(sum(s) FILTER (WHERE cell_type = 'A'), 0), 6) AS A, round(coalesce(sum(s) FILTER (WHERE cell_type = 'N'), 0), 6) AS N,
        round(coalesce(sum(s) FILTER (WHERE cell_type = 'R'), 0), 6) AS R FROM v LEFT JOIN h ON v.marker = h.snp GROUP BY 1""",
    "marker_peak_annotation": ctes("vv", "p") + " SELECT v.marker AS snp, " + ", ".join(f"max(CAST(context = '{c}' AS DOUBLE)) AS p{c[0]}" for c in PRIORITIES) + " FROM v JOIN p ON v.chrom = p.chrom AND v.pos BETWEEN p.s AND p.e GROUP BY 1",
    "reference_sumstats": ctes("vv")
    + """, rf AS (SELECT chrom, pos, min(marker) AS snp FROM v GROUP BY ALL HAVING count(*) = 1)
      SELECT rf.snp AS SNP, event_id % 1000 AS N, round(z, 6) AS Z FROM v JOIN rf USING (chrom, pos) WHERE z IS NOT NULL AND NOT isnan(z) AND event_id % 1000 > 0""",
    "own_sumstats": """WITH x AS (SELECT markerid, n, z, row_number() OVER (PARTITION BY markerid ORDER BY loaded_at, variant_idx, z, n) AS nr FROM variants
      WHERE chrom BETWEEN 1 AND 22 AND isfinite(z) AND n > 0 AND markerid IS NOT NULL) SELECT markerid AS SNP, n AS N, round(z, 6) AS Z FROM x WHERE nr = 1""",
    "predicted_lifted": ctes("l", "p")
    + """, b AS (SELECT chrom, s, min(e) AS e FROM p GROUP BY ALL), x AS (SELECT chrom, s AS pos, gene, cell_type AS mechanism, score FROM l WHERE score >= 0.03),
      m AS (SELECT x.chrom, x.pos, b.s + 1000 + (x.pos - b.s) AS to_pos FROM (SELECT DISTINCT chrom, pos FROM x) x JOIN b ON x.chrom = b.chrom AND x.pos >= b.s AND x.pos < b.e),
      o AS (SELECT chrom, pos, min(to_pos) AS to_pos FROM m GROUP BY ALL HAVING count(*) = 1), u AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY chrom, to_pos) AS c FROM o) WHERE c = 1)
      SELECT x.chrom, u.to_pos AS pos, gene, mechanism, max(score) AS score FROM x JOIN u ON x.chrom = u.chrom AND x.pos = u.pos GROUP BY ALL""",
    "coefficients_reindexed": ctes("a")
    + """, m AS (SELECT gene_idx, mechanism_idx, sum(value) AS mass FROM a GROUP BY 1, 2), g AS (SELECT DISTINCT gene_idx FROM a), k AS (SELECT unnest(range(10)) AS mechanism_idx)
      SELECT g.gene_idx, CAST(k.mechanism_idx AS BIGINT) AS mechanism_idx, coalesce(round(CASE WHEN mass >= 1 THEN mass END, 6), 0) AS coef FROM g, k LEFT JOIN m ON m.gene_idx = g.gene_idx AND m.mechanism_idx = k.mechanism_idx""",
    "normalized_context_mass": ctes("a") + ", m AS (SELECT mechanism_idx, sum(value) AS m FROM a GROUP BY 1) SELECT mechanism_idx, round(m / sum(m) OVER (), 6) AS share FROM m",
    "set_enrichment": """WITH r AS (SELECT source, analysis, split_part(ensembl, '.', 1) AS ensembl, max(score) AS score FROM rankings WHERE ensembl IS NOT NULL AND isfinite(score) GROUP BY ALL),
      k AS (SELECT *, row_number() OVER (PARTITION BY source, analysis ORDER BY score DESC, ensembl) AS rank FROM r),
      s AS (SELECT source, analysis, count(*) AS n_genes, count(*) FILTER (WHERE rank <= 100) AS n_top FROM k GROUP BY ALL),
      h AS (SELECT source, analysis, CAST(CAST(right(ensembl, 6) AS BIGINT) % 40 AS VARCHAR) AS set_name, count(*) AS n_set, count(*) FILTER (WHERE rank <= 100) AS hits FROM k GROUP BY ALL),
      x AS (SELECT source, analysis, set_name, n_genes, n_set, n_top, hits,
        CASE WHEN hits <= greatest(0, n_top + n_set - n_genes) THEN 1.0 ELSE list_sum(list_transform(range(hits, least(n_set, n_top) + 1), lambda x: exp(
          lgamma(n_set + 1) - lgamma(x + 1) - lgamma(n_set - x + 1) + lgamma(n_genes - n_set + 1) - lgamma(n_top - x + 1) - lgamma(n_genes - n_set - n_top + x + 1)
          - lgamma(n_genes + 1) + lgamma(n_top + 1) + lgamma(n_genes - n_top + 1)))) END AS p FROM h JOIN s USING (source, analysis) WHERE hits > 0)
      SELECT * REPLACE (round(p, 6) AS p) FROM x WHERE p < 0.05""",
}
