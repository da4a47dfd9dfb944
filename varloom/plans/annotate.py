"""Composite loaders: from intervals, links and genes to one annotation set over all variants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import annotation_value, keeps_self_promoter, member, variant_id
from ..operators.index import dense_index
from ..operators.intervals import merge_periods
from ..operators.joins import first_per, range_join, range_max
from ..sources.tables import LINE

#: Most genes whose numbers are broadcast (beyond, a join), and links that are looked at first for any overlap.
MOST_GENES, FIRST_LINKS = 2_000_000, 1_000


@dataclass
class Annotation:
    """``variants`` (all of them), ``genes``, the ordered ``mechanisms``, and ``triples`` of their indices with a value."""

    variants: DataFrame
    genes: DataFrame
    mechanisms: list[str]
    triples: DataFrame


def number_variants(gwas: DataFrame) -> DataFrame:
    """One row per coordinate of the autosomes, numbered by chromosome and position."""
    v = gwas.where(F.col("chrom").between(1, 22) & F.col("pos").isNotNull())
    snp = F.col("snp") if "snp" in gwas.columns else F.lit(None).cast("string")
    v = v.select("chrom", "pos", variant_id("chrom", "pos").alias("variant_id"), snp.alias("marker")).groupBy("chrom", "pos", "variant_id").agg(F.min("marker").alias("marker"))
    return dense_index(v, [F.col("chrom"), F.col("pos")], "variant_idx")


def _numbered(genes: DataFrame, order: list[str] | None = None) -> DataFrame:
    """``gene, gene_idx``: numbered by name, or by a gene's first row in the order of some columns."""
    first = genes.groupBy("gene").agg(F.min(F.struct(*order)).alias("_f")) if order else genes.select("gene").distinct()
    return dense_index(first, ([F.col("_f")] if order else []) + [F.col("gene")], "gene_idx").select("gene", "gene_idx")


def _names(mechanisms: list[str], intercept: bool) -> list[str]:
    return (["intercept"] if intercept else []) + [m for m in mechanisms if m != "intercept"]


def _place(names: list[str], mechanism: str = "mechanism") -> Column:
    return F.create_map(*[x for i, m in enumerate(names) for x in (F.lit(m), F.lit(i))])[F.col(mechanism)]


def _with_numbers(df: DataFrame, genes: DataFrame) -> DataFrame:
    return df.join(F.broadcast(genes) if genes.count() <= MOST_GENES else genes, "gene").drop("gene")


def _finish(variants: DataFrame, hits: DataFrame, genes: DataFrame, mechanisms: list[str], intercept: bool, order: list[str] | None = None) -> Annotation:
    """``hits`` is ``variant_idx, gene, mechanism, value``; ``genes`` has ``gene``. The largest value of a key counts.

    Genes are numbered by name, or by their first row in the order of some columns of ``genes``.
    """
    names = _names(mechanisms, intercept)
    if intercept:
        both = F.array(F.struct(F.col("mechanism").alias("m"), F.col("value").alias("v")), F.struct(F.lit("intercept").alias("m"), F.lit(1.0).alias("v")))
        hits = hits.select("variant_idx", "gene", F.explode(both).alias("r")).select("variant_idx", "gene", F.col("r.m").alias("mechanism"), F.col("r.v").alias("value"))
    g = _numbered(genes, order)
    t = hits.where(F.col("mechanism").isin(names)).join(g, "gene").groupBy("variant_idx", "gene_idx", _place(names).alias("mechanism_idx")).agg(F.max("value").alias("value"))
    return Annotation(variants, g, names, t)


def from_links(links: DataFrame, gwas: DataFrame, min_score: float = 0.015, cell_types: list[str] | str | None = None, exclude_self_promoter: bool = False, intercept: bool = True) -> Annotation:
    """Variants inside scored links. Genes without a variant keep their number; no overlap at all is an error.

    Links that were read with their places number genes and cell types as the file first shows them, on the variants' chromosomes.
    Genes get their number before the join, which gives each variant its largest values, so the hits are not shuffled.
    """
    v = number_variants(gwas)
    points = v.select("variant_idx", "chrom", "pos")
    x = links.where((F.col("score") >= min_score) & member("cell_type", cell_types))
    if exclude_self_promoter:
        x = x.where(keeps_self_promoter("is_self_promoter"))
    order = LINE if set(LINE) <= set(links.columns) else None
    if order:
        x = x.join(F.broadcast(v.select("chrom").distinct()), "chrom", "left_semi")  # the autosomes
    good = F.col("end") >= F.col("start")
    seen = x.groupBy("cell_type").agg(F.min(F.struct(*(order or ["cell_type"]))).alias("f"), F.count_if(good).alias("n"), F.sum(F.when(good, F.col("end") - F.col("start") + 1).otherwise(0)).alias("length")).collect()  # the cell types
    names = _names([r["cell_type"] for r in sorted(seen, key=lambda r: tuple(r["f"])) if r["cell_type"] is not None], intercept)
    cols = ["chrom", "start", "end"]
    any_ = lambda some: range_join(points, some.where("gene is not null and cell_type is not null").select(*cols), ["chrom"], "pos", "start", "end")
    if any_(x.limit(FIRST_LINKS)).isEmpty() and any_(x).isEmpty():
        raise ValueError("no variant lies in a link")
    g = _numbered(x, order)
    iv = _with_numbers(x.where("cell_type is not null").select(*cols, "gene", _place(names, "cell_type").alias("mechanism_idx"), F.col("score").alias("value")), g)
    one = lambda m, value: F.struct(F.col("gene_idx"), m.alias("mechanism_idx"), value.alias("value"))
    both = F.array(one(F.col("mechanism_idx"), F.col("value").cast("double")), one(F.lit(0), F.lit(1.0))) if intercept else None
    t = range_max(points, iv, ["chrom"], "pos", "start", "end", ["gene_idx", "mechanism_idx"], "value", both, size=(sum(r["n"] for r in seen), sum(r["length"] for r in seen)))
    return Annotation(v, g, names, t.select("variant_idx", "gene_idx", "mechanism_idx", "value"))


def peak_contexts(variants: DataFrame, peaks: DataFrame, contexts: list[str]) -> DataFrame:
    """``variant_idx, intercept, contexts...`` as 0/1: every variant, the intercept being the union."""
    hit = range_join(variants.select("variant_idx", "chrom", "pos"), peaks, ["chrom"], "pos", "start", "end")
    wide = hit.groupBy("variant_idx").agg(*[F.max((F.col("context") == c).cast("int")).alias(c) for c in contexts])
    out = variants.select("variant_idx").join(wide, "variant_idx", "left").na.fill(0)
    return out.select("variant_idx", (F.greatest(*contexts) if len(contexts) > 1 else F.col(contexts[0])).alias("intercept"), *contexts)


def from_peaks_and_genes(peaks: DataFrame, tss: DataFrame, gwas: DataFrame, contexts: list[str], window: int = 100_000, intercept: bool = True) -> Annotation:
    """Variants in a context's peak, linked to the genes of that context within the window; genes without a link keep their number."""
    v, names = number_variants(gwas), _names(contexts, intercept)
    peaks = peaks.where(F.col("context").isin(names) & (F.col("end") >= F.col("start"))).select("chrom", "context", "start", (F.col("end") + 1).alias("stop"))
    merged = merge_periods(peaks, ["chrom", "context"], "start", "stop", ["chrom", "context"])  # a variant lies in one of a context at most
    inside = range_join(v.select("variant_idx", "chrom", "pos"), merged, ["chrom"], "pos", "from_pos", "to_pos", half_open=True)
    points = inside.groupBy("variant_idx", "chrom", "pos").agg(F.collect_set(_place(names, "context")).alias("_in"))
    g = _numbered(tss)
    near = _with_numbers(tss.where(F.col("context").isin(names)).select("chrom", (F.col("tss") - window).alias("start"), (F.col("tss") + window).alias("end"), "gene", _place(names, "context").alias("m")), g)
    pairs = range_max(points, near, ["chrom"], "pos", "start", "end", ["gene_idx"], "m", whole=True)  # a pair once, with the gene's contexts there, so pairs are not shuffled
    both = F.array_intersect("_in", "m")
    own = F.when(F.size(both) > 0, F.array_distinct(F.concat(F.array(F.lit(0)), both)) if intercept else both)
    return Annotation(v, g, names, pairs.select("variant_idx", "gene_idx", F.explode(own).alias("mechanism_idx"), F.lit(1.0).alias("value")))


def from_predicted(links: DataFrame, gwas: DataFrame, contexts: list[str], min_score: float = 0.9, intercept: bool = True) -> Annotation:
    """Predicted position-gene links (``chrom, pos, gene, mechanism, score``); only genes that match a variant are kept, numbered by their first chromosome, then by name."""
    v = number_variants(gwas)
    hits = links.where(F.col("score") >= min_score).where(F.col("mechanism").isin(contexts)).join(v.select("variant_idx", "chrom", "pos"), ["chrom", "pos"])
    hits = hits.select("variant_idx", "gene", "mechanism", F.col("score").cast("double").alias("value"), "chrom")
    return _finish(v, hits.drop("chrom"), hits, contexts, intercept, ["chrom"])


def from_associations(assoc: DataFrame, contexts: list[str], value: str = "z2", max_genes: int | None = None, intercept: bool = True) -> Annotation:
    """Lead associations (``gene, chrom, pos, marker, beta, z, p, context``); the universe is the associated variants.

    ``max_genes`` keeps the genes with the largest absolute z.
    """
    a = assoc.withColumn("value", annotation_value(value)).where("value > 0")
    if max_genes is not None:
        top = a.groupBy("gene").agg(F.max(F.abs("z")).alias("m")).orderBy(F.col("m").desc(), "gene").limit(max_genes).select("gene")
        a = a.join(top, "gene", "left_semi")
    v = number_variants(a.withColumnRenamed("marker", "snp"))
    hits = a.join(v.select("variant_idx", "chrom", "pos"), ["chrom", "pos"]).select("variant_idx", "gene", F.col("context").alias("mechanism"), "value")
    return _finish(v, hits, hits, contexts, intercept)


SOURCES = {"links": from_links, "peaks": from_peaks_and_genes, "predicted": from_predicted, "associations": from_associations}


def training_table(variants: DataFrame, gwas: DataFrame) -> tuple[DataFrame, str]:
    """Variants with a statistic, by marker or, if no marker matches at all, by coordinate; the first row of a key counts."""
    from ..operators.joins import align_global

    g = gwas.withColumn("vid", variant_id("chrom", "pos"))
    order = [F.col("chrom"), F.col("pos"), F.col("chisq")]
    out, key = align_global(variants.select("variant_idx", "marker", "variant_id"), g.select("snp", "vid", "chrom", "pos", "z", "chisq", "n"), [("marker", "snp"), ("variant_id", "vid")], order)
    return first_per(out, ["variant_idx"], [F.col("chisq")]).select("variant_idx", "z", "chisq", "n"), key
