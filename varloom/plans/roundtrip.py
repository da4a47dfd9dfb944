"""Queries that write stand-in tables to files of the outside layouts and read them back through the readers, with SQL over the tables themselves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import annotation_value, p_to_z
from ..operators import sparse as sp
from ..operators.joins import first_per
from ..session import Scratch, table
from ..sources import gwas as gw, sinks, tables
from ..sources.results import name_values, read_coefficients, read_context_effects, read_metadata
from ..stats.fit import Fit
from ..streaming.annotate import annotate_stream, stream_points
from . import annotate as an, lens, prepare as pp
from .lens import ctes
from .matrices import CONTEXTS

TEXT = {"header": True, "sep": "\t"}


def _folder(spark: SparkSession) -> str:
    """A folder of the shared area that goes when the application ends."""
    s = Scratch(spark, "files")
    fs, root = s._fs(s.root)
    fs.mkdirs(root)
    fs.deleteOnExit(root)
    return s.root


def _text(df: DataFrame, path: str, **options) -> str:
    df.write.options(**{**TEXT, **options}).csv(path)
    return path


def gwas_scan(spark: SparkSession, d: str) -> DataFrame:
    """Associations from a tab-separated text with ``beta`` and ``se`` columns under other names."""
    v = lens.variants(spark, d)
    x = v.select(F.concat(F.lit("chr"), "chrom").alias("#chrom"), F.col("pos").alias("base_pair_location"), F.col("marker").alias("rsid"), (F.col("z") * 0.5).alias("effect"), F.lit("0.5").alias("standard_error"), (F.col("event_id") % 1000).alias("neff"))
    out = gw.read_gwas(spark, _text(x, f"{_folder(spark)}/gwas.tsv.gz", compression="gzip"))
    return out.select("chrom", "pos", "variant_id", "snp", F.round("z", 6).alias("z"), F.round("chisq", 6).alias("chisq"), F.col("n").cast("long").alias("n"))


def gwas_scan_p(spark: SparkSession, d: str) -> DataFrame:
    """The z of two-sided p-values, of ten classes whose quantiles are known."""
    e = table(spark, d, "events")
    at = F.array(*[F.lit(p) for p in P_Z])
    x = e.select((1 + F.col("user_id") % 22).alias("CHR"), F.col("event_id").alias("BP"), at[(F.col("event_id") % len(P_Z)).cast("int")].alias("P"))
    out = gw.read_gwas(spark, _text(x, f"{_folder(spark)}/p.tsv"))
    return out.groupBy("chrom", F.round("z", 5).alias("z")).agg(F.count(F.lit(1)).alias("n"))


#: Two-sided p-values and the normal's upper quantiles of their halves.
P_Z = {"0.5": 0.67449, "0.2": 1.28155, "0.1": 1.64485, "0.05": 1.95996, "0.02": 2.32635, "0.01": 2.57583, "0.001": 3.29053, "1e-4": 3.89059, "1e-5": 4.41717, "1e-8": 5.73073}


def top_association_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lead associations of one file a context, with the four annotation values."""
    root, v = _folder(spark), lens.variants(spark, d)
    codes = {"AA": "first", "BB": "second"}
    part = F.when(F.col("event_id") % 2 == 0, "AA").otherwise("BB")
    x = v.select(part.alias("part"), F.concat(F.lit("E"), "event_id").alias("feature"), F.col("chrom").alias("CHR"), F.col("pos").alias("POS"), F.col("marker").alias("MarkerID"), (F.col("z") / 4).alias("BETA"), F.lit("0.25").alias("SE"), F.col("z").alias("Tstat"), ((F.col("event_id") % 999 + 1) / 1000).alias("p.value"), F.lit(1).alias("N"))
    x.repartition("part").write.partitionBy("part").options(**TEXT).csv(f"{root}/assoc")
    sinks.name_parts(spark, f"{root}/assoc", "{}_top_assoc.tsv")
    a = gw.read_top_associations(spark, f"{root}/assoc/*_top_assoc.tsv", codes)
    values = [F.round(annotation_value(k), 6).alias(k) for k in ("z2", "abs_z", "beta2", "neglog10p")]
    return a.select("gene", "chrom", "pos", "marker", "context", *values)


def link_scan(spark: SparkSession, d: str) -> DataFrame:
    """S3: scored links from text, per cell type and promoter flag."""
    x = lens.links(spark, d)
    x = x.select(F.concat(F.lit("chr"), "chrom").alias("chr"), "start", "end", F.col("gene").alias("TargetGene"), F.col("score").alias("ABC.Score"), F.col("cell_type").alias("CellType"), F.col("is_self_promoter").alias("isSelfPromoter"))
    out = tables.read_links(spark, _text(x, f"{_folder(spark)}/links.tsv"))
    return out.groupBy("chrom", "cell_type", "is_self_promoter").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.countDistinct("gene").alias("genes"), F.round(F.sum("score"), 4).alias("scores"))


def bed_scan(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of a text without header."""
    x = table(spark, d, "peaks").where("start is not null and end is not null and chrom is not null").select("chrom", "start", "end", "sample_id")
    return tables.read_bed(spark, _text(x, f"{_folder(spark)}/a.bed", header=False)).select("chrom", F.col("start").alias("from_pos"), F.col("end").alias("to_pos"))


def tss_scan(spark: SparkSession, d: str) -> DataFrame:
    """Gene starts."""
    x = lens.tss(spark, d).select(F.concat(F.lit("chr"), "chrom").alias("chrom"), "tss", "gene", F.concat(F.lit("c"), F.col("context_idx").cast("string")).alias("CellType"))
    return tables.read_tss(spark, _text(x, f"{_folder(spark)}/tss.tsv"), [f"c{i}" for i in range(5)])


def _bim_file(spark: SparkSession, d: str, root: str) -> str:
    v = lens.variants(spark, d).select("chrom", "marker", F.lit(0).alias("cm"), "pos", F.lit("A").alias("a"), F.lit("G").alias("b"), "event_id")
    return _text(v.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").drop("event_id"), f"{root}/x.bim", header=False, sep=" ")


def bim_scan(spark: SparkSession, d: str) -> DataFrame:
    """Markers numbered in the order of the file, over all its splits."""
    return tables.read_bim(spark, _bim_file(spark, d, _folder(spark))).select("chrom", "snp", "pos", "bim_row")


def ld_metadata_scan(spark: SparkSession, d: str) -> DataFrame:
    """LD metadata in file order."""
    v = lens.gwas(spark, d).select(F.concat(F.lit("rs"), "variant_idx").alias("rsid"), F.col("chrom").alias("chromosome"), F.col("pos").alias("position"), F.lit("A").alias("allele1"), F.lit("C").alias("allele2"), "variant_idx")
    path = f"{_folder(spark)}/meta.txt"
    v.repartitionByRange(3, "variant_idx").sortWithinPartitions("variant_idx").drop("variant_idx").write.options(header=True, sep=" ").csv(path)
    return tables.read_ld_metadata(spark, path).select("snp", "chrom", "pos", "variant_id", "ld_row")


def ld_block_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Correlations of a block's chosen rows, squared, adjusted for a sample of 500 and cut."""
    raw = table(spark, d, "ld_blocks").where("r2 >= 0 and r2 <= 1 and row_idx <> col_idx")
    edges = raw.groupBy("row_idx", "col_idx").agg(F.sqrt(F.max("r2")).alias("r"))
    meta = table(spark, d, "variants").select(F.col("variant_idx").alias("ld_row")).distinct()
    chosen = lens.triples(spark, d).select(F.col("variant_idx").alias("ld_row"), "variant_idx").distinct()
    return tables.ld_block_edges(edges, meta, chosen, 0.02, 500).select("row_idx", "col_idx", F.round("r2", 6).alias("r2"))


def source_link_scan(spark: SparkSession, d: str) -> DataFrame:
    """Source links of one chromosome, partition and probability pushed to the scan."""
    path = f"{_folder(spark)}/source"
    x = lens.links(spark, d).select(F.col("start").alias("pos"), F.col("gene").alias("gene_id"), F.col("score").cast("double").alias("pred_prob"), F.concat(F.lit("chr"), "chrom").alias("chr"))
    x.repartition("chr").write.partitionBy("chr").parquet(path)
    return tables.read_source_links(spark, path, 3, 0.05)


def prepared_partition_scan(spark: SparkSession, d: str) -> DataFrame:
    """Prepared links of one chromosome from zstd partitions."""
    path = f"{_folder(spark)}/prepared"
    x = lens.links(spark, d).select(F.col("chrom").cast("short").alias("chrom"), F.col("start").alias("pos"), "gene", F.col("cell_type").alias("mechanism"), F.col("score").cast("float").alias("score"))
    sinks.write_links(x, path)
    return tables.read_predicted(spark, path, 2, 0.05).select("pos", "gene", "mechanism", F.round(F.col("score").cast("double"), 6).alias("score"))


def gtf_scan(spark: SparkSession, d: str) -> DataFrame:
    """Gene symbols, a gene's first line counting."""
    p = table(spark, d, "part").where("p_partkey is not null")
    line = F.concat_ws("\t", F.lit("1"), F.lit("s"), F.when(F.col("p_partkey") % 3 == 0, "exon").otherwise("gene"), F.lit("1"), F.lit("2"), F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit('gene_id "E'), (F.col("p_partkey") % 500).cast("string"), F.lit('.7"; '), F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit('gene_name "N'), "p_partkey", F.lit('";'))).otherwise(F.lit(""))))
    path = f"{_folder(spark)}/g.gtf"
    p.select(line.alias("value"), "p_partkey").repartitionByRange(3, "p_partkey").sortWithinPartitions("p_partkey").select("value").write.text(path)
    return tables.read_gtf_symbols(spark, path)


def target_scan(spark: SparkSession, d: str) -> DataFrame:
    """Targets of a JSON export."""
    c = table(spark, d, "supplier").select(F.concat(F.lit("E"), (F.col("s_suppkey") % 40).cast("string"), F.lit(".1")).alias("ensembl_gene_id"), F.concat(F.lit("S"), "s_suppkey").alias("hgnc_symbol"), (F.col("s_suppkey") % 7).alias("total_nominations"))
    root = _folder(spark)
    c.agg(F.to_json(F.struct(F.collect_list(F.struct("*")).alias("items"))).alias("value")).write.text(f"{root}/t.json")  # an export is one value
    return tables.read_targets(spark, f"{root}/t.json")


def extracted_scan(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a variant-call file, prepared: NE where positive, else NS; the alternative allele is the effect's."""
    v = lens.variants(spark, d)
    x = v.select(F.concat(F.lit("chr"), "chrom").alias("CHROM"), F.col("pos").alias("POS"), F.col("marker").alias("ID"), F.lit("a").alias("REF"), F.lit("g").alias("ALT"), (F.col("z") / 10).alias("ES"), F.lit("0.1").alias("SE"), F.lit("2").alias("LP"), (F.col("event_id") % 50).alias("NS"), (F.col("event_id") % 7).alias("NE"))
    root = _folder(spark)
    gw.prepare_study(gw.read_delimited(spark, _text(x, f"{root}/in.tsv")), gw.layout("extracted"), f"{root}/out")
    out = spark.read.csv(f"{root}/out/table", **TEXT)
    d_ = lambda c: F.col(c).cast("double")
    return out.select(d_("CHR").cast("int").alias("CHR"), d_("BP").cast("long").alias("BP"), "SNP", "A1", "A2", F.round(d_("BETA"), 6).alias("BETA"), d_("N").cast("long").alias("N"))


def study_preparation(spark: SparkSession, d: str) -> DataFrame:
    """A study of odds ratios with half sizes, lifted by ten bases on even chromosomes; odd ones do not lift."""
    v = lens.variants(spark, d)
    x = v.select(F.col("chrom").alias("CHR"), F.col("pos").alias("BP"), F.col("marker").alias("SNP"), F.lit("a").alias("A1"), F.lit("t").alias("A2"), F.exp(F.col("z") / 10).alias("OR"), F.when(F.col("event_id") % 11 == 0, "0").otherwise("0.1").alias("SE"), (F.col("event_id") % 9).alias("Neff_half"))
    root = _folder(spark)
    blocks = spark.range(1, 23).select(F.col("id").cast("int").alias("chrom"), F.lit(0).cast("long").alias("start"), F.lit(10**9).cast("long").alias("end"), F.col("id").cast("int").alias("to_chrom"), F.lit(10).cast("long").alias("to_start"), F.lit(True).alias("forward")).where("chrom % 2 = 0")
    gw.prepare_study(gw.read_delimited(spark, _text(x, f"{root}/in.tsv")), gw.layout("bipolar"), f"{root}/out", blocks)
    out = gw.read_gwas(spark, f"{root}/out/table")
    return out.select("chrom", "pos", "snp", F.round("z", 5).alias("z"), F.col("n").cast("long").alias("n"))


def link_loader(spark: SparkSession, d: str) -> DataFrame:
    """Annotations of variants inside links; genes and cell types numbered as the file shows them."""
    x = table(spark, d, "lineitem").select(*_ROW, F.col("l_quantity").cast("long").alias("q"), F.col("l_discount").alias("ABC.Score"), F.col("l_returnflag").alias("CellType"), (F.col("l_linestatus") == "O").alias("isSelfPromoter"))
    x = x.repartitionByRange(3, *_ROW)  # what follows from these columns is made after the shuffle
    x = x.select((1 + F.col("l_suppkey") % 22).alias("c"), ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % lens.SPAN).alias("s"), "q", F.concat(F.lit("G"), "l_partkey").alias("TargetGene"), "`ABC.Score`", "CellType", "isSelfPromoter", *_ROW)
    x = x.sortWithinPartitions(*_ROW, "s", "q", "`ABC.Score`", "TargetGene")
    x = x.select(F.concat(F.lit("chr"), "c").alias("chr"), F.col("s").alias("start"), (F.col("s") + F.col("q") * 20).alias("end"), "TargetGene", "`ABC.Score`", "CellType", "isSelfPromoter")
    links = tables.read_links(spark, _text(x, f"{_folder(spark)}/l.tsv.gz", compression="gzip"), ordered=True)
    a = an.from_links(links, _lens_gwas(spark, d))
    n = a.triples.groupBy("gene_idx", "mechanism_idx").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return n.join(a.genes, "gene_idx").select("gene_idx", "gene", "mechanism_idx", "n", "value")


_ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _lens_gwas(spark: SparkSession, d: str) -> DataFrame:
    return lens.variants(spark, d).select("chrom", "pos", F.col("marker").alias("snp"))


def peak_context_loader(spark: SparkSession, d: str) -> DataFrame:
    """Variants with 0/1 per context and their union."""
    v = an.number_variants(_lens_gwas(spark, d))
    out = an.peak_contexts(v, lens.peaks(spark, d), pp.PRIORITIES)
    return out.select("variant_idx", "intercept", *[F.col(f"`{c}`").alias(f"p{c[0]}") for c in pp.PRIORITIES])


def peak_gene_loader(spark: SparkSession, d: str) -> DataFrame:
    """C4: variants in peaks linked to gene starts of the same context."""
    p = lens.peaks(spark, d)
    names = [f"c{i}" for i in range(1, 6)]
    p = p.withColumn("context", F.concat(F.lit("c"), F.substring("context", 1, 1)))
    t = lens.tss(spark, d).select("chrom", "tss", "gene", F.concat(F.lit("c"), (F.col("context_idx") + 1).cast("string")).alias("context"))
    a = an.from_peaks_and_genes(p, t, _lens_gwas(spark, d), names, 20_000)
    return a.triples.groupBy("gene_idx", "mechanism_idx").agg(F.count(F.lit(1)).alias("n")).join(a.genes, "gene_idx").select("gene_idx", "gene", "mechanism_idx", "n")


def predicted_loader(spark: SparkSession, d: str) -> DataFrame:
    """Predicted links at variants; genes numbered by chromosome, then name."""
    x = table(spark, d, "part").select(F.col("p_partkey"), F.concat(F.lit("G"), "p_partkey").alias("gene"))
    v = lens.variants(spark, d).select("chrom", "pos", "event_id")
    links = v.join(x, (F.col("event_id") % 200) == F.col("p_partkey")).select("chrom", "pos", "gene", F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("mechanism"), (F.lit(0.85) + (F.col("event_id") % 10) / 100).alias("score"))
    a = an.from_predicted(links, _lens_gwas(spark, d), ["m0", "m1", "m2"])
    return a.triples.join(a.genes, "gene_idx").groupBy("gene_idx", "gene", "mechanism_idx").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


def association_loader(spark: SparkSession, d: str) -> DataFrame:
    """Lead associations as annotations, of the hundred genes with the largest absolute z."""
    v = lens.variants(spark, d)
    a = v.select(F.concat(F.lit("E"), (F.col("event_id") % 500).cast("string")).alias("gene"), "chrom", "pos", "marker", (F.col("z") / 4).alias("beta"), "z", F.lit(0.5).alias("p"), F.concat(F.lit("c"), (F.col("event_id") % 2).cast("string")).alias("context"))
    s = an.from_associations(a, ["c0", "c1"], max_genes=100)
    return s.triples.join(s.genes, "gene_idx").groupBy("gene_idx", "gene", "mechanism_idx").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


def annotation_files(spark: SparkSession, d: str) -> DataFrame:
    """K1, C14: annotation files of peaks for every marker of a BIM, under the names of their chromosomes."""
    root = _folder(spark)
    bim = tables.read_bim(spark, _bim_file(spark, d, root))
    pp.build_baseline("peaks", bim, lens.peaks(spark, d).withColumn("context", F.concat(F.lit("p"), F.substring("context", 1, 1))), [f"p{i}" for i in range(1, 6)], f"{root}/annot")
    sinks.name_parts(spark, f"{root}/annot", "x.{}.annot.gz")
    out = spark.read.csv(f"{root}/annot/x.*.annot.gz", **TEXT)
    return out.select(F.col("CHR").cast("int"), F.col("BP").cast("long"), "SNP", *[F.col(f"p{i}").cast("double").cast("int").alias(f"p{i}") for i in range(1, 6)])


def predicted_annotation_files(spark: SparkSession, d: str) -> DataFrame:
    """C11, C14: the same of predicted links, summed over genes."""
    root = _folder(spark)
    bim = tables.read_bim(spark, _bim_file(spark, d, root))
    v = lens.variants(spark, d).select("chrom", "pos", "event_id")
    links = v.select("chrom", "pos", F.explode(F.array(*[F.lit(f"G{i}") for i in range(3)])).alias("gene"), F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("mechanism"), (F.lit(0.85) + (F.col("event_id") % 10) / 100).alias("score"))
    pp.build_baseline("predicted", bim, links, ["m0", "m1", "m2"], f"{root}/annot")
    out = spark.read.csv(f"{root}/annot", **TEXT)
    return out.select(F.col("CHR").cast("int"), F.col("BP").cast("long"), "SNP", *[F.round(F.col(f"m{i}").cast("double"), 4).alias(f"m{i}") for i in range(3)])


def _reference(spark: SparkSession, d: str) -> str:
    root = _folder(spark)
    g = lens.gwas(spark, d).select("variant_idx", F.col("chrom").alias("CHR"), F.concat(F.lit("v"), "variant_idx").alias("SNP"), F.col("pos").alias("BP"))
    pp.write_reference(lens.matrix(spark, d), sp.context_scores(lens.triples(spark, d)), g, CONTEXTS, f"{root}/ref")
    return f"{root}/ref"


def ldsc_reference_m(spark: SparkSession, d: str) -> DataFrame:
    """The sums of the annotations, as both files hold them."""
    root = _reference(spark, d)
    read = lambda n: spark.read.csv(f"{root}/{n}", **TEXT)
    x = read("m").join(read("m_5_50").select("CHR"), "CHR")
    return x.select(F.col("CHR").cast("int"), *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ["base", *[f"L{c}" for c in CONTEXTS]]])


def ldsc_reference_files(spark: SparkSession, d: str) -> DataFrame:
    """Scores, annotations and weights, joined again by marker."""
    root = _reference(spark, d)
    sinks.name_parts(spark, f"{root}/reference", "ref.{}.l2.ldscore.gz")
    read = lambda n: spark.read.csv(f"{root}/{n}", **TEXT)
    ref, an_, w = read("reference/ref.*.l2.ldscore.gz"), read("annot"), read("weights")
    num = lambda c: F.round(F.col(c).cast("double"), 5)
    x = ref.select(F.col("CHR").cast("int"), "SNP", F.col("BP").cast("long"), num("base").alias("base"), num("L1").alias("L1"), num("L9").alias("L9"))
    return x.join(an_.select("SNP", num("L1").alias("a1")), "SNP").join(w.select("SNP", num("LD_weights").alias("weight")), "SNP")


def sumstats_file(spark: SparkSession, d: str) -> DataFrame:
    """K3: statistics for external regression, written and read."""
    path = f"{_folder(spark)}/s.sumstats"
    v = lens.variants(spark, d)
    sinks.write_sumstats(v.select(F.col("marker").alias("SNP"), F.lit(1000).alias("N"), F.col("z").alias("Z")), path)
    out = spark.read.csv(path, **TEXT)
    return out.select("SNP", F.col("N").cast("int"), F.round(F.col("Z").cast("double"), 6).alias("Z"))


def lifted_links(spark: SparkSession, d: str) -> DataFrame:
    """Links lifted at both ends, by cell type: rows in, mapped and not."""
    blocks = spark.range(1, 23).select(F.col("id").cast("int").alias("chrom"), F.lit(0).cast("long").alias("start"), F.lit(2_000_000).cast("long").alias("end"), F.col("id").cast("int").alias("to_chrom"), F.lit(500).cast("long").alias("to_start"), (F.col("id") % 2 == 0).alias("forward"))
    new, counts = pp.lift_links(lens.links(spark, d), blocks)
    s = new.groupBy("cell_type").agg(F.sum("start").alias("starts"), F.sum(F.col("end") - F.col("start")).alias("length"))
    return counts.join(s, "cell_type")


def expressed_starts(spark: SparkSession, d: str) -> DataFrame:
    """Starts of expressed genes, lifted, each once."""
    t = lens.tss(spark, d).select("chrom", "tss", "gene", (F.col("context_idx") % 2 == 0).alias("expressed"), F.concat(F.lit("c"), F.col("context_idx").cast("string")).alias("cell_type"))
    blocks = spark.range(1, 23).select(F.col("id").cast("int").alias("chrom"), F.lit(0).cast("long").alias("start"), F.lit(2_000_000).cast("long").alias("end"), F.col("id").cast("int").alias("to_chrom"), F.lit(500).cast("long").alias("to_start"), F.lit(True).alias("forward"))
    return pp.expressed_genes(t.union(t), blocks)


def marker_identity(spark: SparkSession, d: str) -> DataFrame:
    """Names and alleles of variants from LD metadata, half of them by marker, the others by coordinate."""
    g = lens.gwas(spark, d).select("variant_idx", "chrom", "pos", "variant_id")
    v = g.withColumn("marker", F.when(F.col("variant_idx") % 2 == 0, F.concat(F.lit("rs"), "variant_idx")))
    v = first_per(v, ["variant_id"], [F.col("variant_idx")])
    meta = v.select(F.concat(F.lit("rs"), "variant_idx").alias("snp"), "chrom", "pos", F.lit("A").alias("a1"), F.lit("C").alias("a2"), F.col("variant_id"), F.col("variant_idx").alias("ld_row"))
    return pp.snp_identity(v, meta)


def fold_cache(spark: SparkSession, d: str) -> DataFrame:
    """C17: stored folds by way of their cache; a cache of another length gives nothing."""
    f = table(spark, d, "cv_folds").groupBy("variant_idx").agg(F.max("cv_groups").alias("cv_groups"), F.max("cv_score_groups").alias("cv_score_groups"))
    ids = table(spark, d, "cv_folds").select("variant_idx").distinct()
    from ..operators.index import dense_index

    f = f.join(dense_index(ids, [F.col("variant_idx")], "k"), "variant_idx").select(F.col("k").alias("variant_idx"), "cv_groups", "cv_score_groups")
    n, root = ids.count(), _folder(spark)
    cache = sinks.FoldCache(f"{root}/arrays", 10, 0.01)
    cache.put(f, {"n": n})
    if cache.get(spark, n + 1) is not None:
        raise AssertionError("a cache of another length was read")
    folds, meta = sinks.FoldCache(f"{root}/arrays", 10, 0.01).get(spark, n)
    return folds.groupBy("cv_groups", "cv_score_groups").agg(F.count(F.lit(1)).alias("n"), F.sum("variant_idx").alias("ids")).withColumn("whole", F.lit(meta["n"] == n))


def table_cache(spark: SparkSession, d: str) -> DataFrame:
    """A cached table under its key, with its manifest."""
    root = _folder(spark)
    v = lens.variants(spark, d).select("event_id", "chrom", "pos")
    sinks.TableCache(root, source="events", cut=1).put("variants", v)
    got = sinks.TableCache(root, cut=1, source="events").get(spark, "variants")
    m = sinks.manifest(got, ["pos", "event_id"])
    return spark.createDataFrame([(m["n"], m["min_pos"], m["max_pos"], m["max_event_id"])], "n long, min_pos long, max_pos long, max_id long")


def run_files(spark: SparkSession, d: str) -> DataFrame:
    """Runs written and read back: coefficients, effects, contributions and metadata of all runs under a folder."""
    root, contexts = _folder(spark), [f"c{c}" for c in CONTEXTS]
    mass = sp.mass(lens.triples(spark, d)).where(F.col("mechanism_idx").isin(CONTEXTS))
    by = {r["mechanism_idx"]: float(r["m"]) for r in mass.groupBy("mechanism_idx").agg(F.sum("mass").alias("m")).collect()}  # the contexts
    effects = np.array([by.get(c, 0.0) for c in CONTEXTS])
    named = name_values(["one=1", "two=2"])
    for name, factor in named.items():
        fit = Fit("hierarchical", np.outer([1.0, 2.0], effects) * float(factor), 0.5, effects * float(factor), np.zeros(len(contexts)))
        diag = spark.createDataFrame([(1, 2)], "chrom int, n long")
        pp.write_fit(spark, f"{root}/{name}", fit, ["g1", "g2"], contexts, {"trait": name}, mass.groupBy("mechanism_idx").agg(F.sum("mass").alias("total_h2")), diag)
        wide = spark.read.parquet(f"{root}/{name}/coefficients").groupBy("gene").pivot("mechanism", contexts).agg(F.first("coef"))
        _text(wide, f"{root}/{name}/b.tsv")
        _text(spark.read.parquet(f"{root}/{name}/context_effects").coalesce(1), f"{root}/{name}/effects.tsv")
    meta = read_metadata(spark, f"{root}/*/metadata.json").select("trait", "tau")
    rows = []
    for name in named:
        sums = {r["mechanism"]: r["s"] for r in read_coefficients(spark, f"{root}/{name}/b.tsv", contexts).groupBy("mechanism").agg(F.sum("coef").alias("s")).collect()}
        rows += [(name, c, round(e, 6), round(sums[c], 6)) for c, e, _ in read_context_effects(spark, f"{root}/{name}/effects.tsv", contexts)]
    return spark.createDataFrame(rows, "trait string, context string, effect double, coefs double").join(meta, "trait")


def stream_annotation(spark: SparkSession, d: str) -> DataFrame:
    """Arriving files of positions joined with standing intervals, all that is there at once."""
    root = _folder(spark)
    lens.variants(spark, d).select("chrom", "pos").write.parquet(f"{root}/in")
    iv = lens.peaks(spark, d).select("chrom", "start", "end", F.col("context").alias("gene"))
    q = annotate_stream(stream_points(spark, f"{root}/in", "chrom int, pos long"), iv, f"{root}/out", f"{root}/chk")
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("chrom", F.col("gene").alias("context")).agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("positions"))


QUERIES = {f.__name__: f for f in (
    gwas_scan, gwas_scan_p, top_association_scan, link_scan, bed_scan, tss_scan, bim_scan, ld_metadata_scan, ld_block_assembly, source_link_scan, prepared_partition_scan,
    gtf_scan, target_scan, extracted_scan, study_preparation, link_loader, peak_context_loader, peak_gene_loader, predicted_loader, association_loader, annotation_files,
    predicted_annotation_files, ldsc_reference_m, ldsc_reference_files, sumstats_file, lifted_links, expressed_starts, marker_identity, fold_cache, table_cache, run_files, stream_annotation,
)}

_NV = ctes("vv", "l", "p", "t") + ", nv AS (SELECT chrom, pos, row_number() OVER (ORDER BY chrom, pos) - 1 AS variant_idx FROM (SELECT DISTINCT chrom, pos FROM v))"
_P = [f"p{c[0]}" for c in pp.PRIORITIES]
_FLAG = ", ".join(f"coalesce(max(CASE WHEN p.context = '{c}' THEN 1 ELSE 0 END), 0) AS p{c[0]}" for c in pp.PRIORITIES)
_CS = ctes("g", "a", "ld") + ", cs AS (SELECT variant_idx, mechanism_idx, sum(value) AS v FROM a WHERE mechanism_idx BETWEEN 1 AND 9 GROUP BY 1, 2)"
ORACLES = {
    "gwas_scan": ctes("vv") + " SELECT chrom, pos, variant_id, marker AS snp, round(z, 6) AS z, round(z * z, 6) AS chisq, event_id % 1000 AS n FROM v WHERE isfinite(z)",
    "gwas_scan_p": f"SELECT CAST(1 + user_id % 22 AS INT) AS chrom, [{', '.join(f'{z}::DOUBLE' for z in P_Z.values())}][event_id % 10 + 1] AS z, count(*) AS n FROM events GROUP BY ALL",
    "top_association_scan": ctes("vv")
    + """ SELECT 'E' || event_id AS gene, chrom, pos, marker, CASE event_id % 2 WHEN 0 THEN 'first' ELSE 'second' END AS context, round(z * z, 6) AS z2, round(abs(z), 6) AS abs_z,
      round((z / 4) * (z / 4), 6) AS beta2, round(-log10((event_id % 999 + 1) / 1000), 6) AS neglog10p FROM v""",
    "link_scan": ctes("l") + " SELECT chrom, cell_type, CAST(is_self_promoter AS VARCHAR) AS is_self_promoter, count(*) AS n, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends, count(DISTINCT gene) AS genes, round(sum(score), 4) AS scores FROM l GROUP BY ALL",
    "bed_scan": r"""SELECT TRY_CAST(regexp_replace(chrom, '^chr', '', 'i') AS INT) AS chrom, "start" AS from_pos, "end" AS to_pos FROM peaks
      WHERE TRY_CAST(regexp_replace(chrom, '^chr', '', 'i') AS INT) BETWEEN 1 AND 22 AND "end" > "start" """,
    "tss_scan": ctes("t") + " SELECT DISTINCT chrom, tss, gene, 'c' || context_idx AS context FROM t",
    "bim_scan": ctes("vv") + " SELECT chrom, marker AS snp, pos, row_number() OVER (ORDER BY event_id) - 1 AS bim_row FROM v",
    "ld_metadata_scan": ctes("g") + " SELECT 'rs' || variant_idx AS snp, chrom, pos, 'chr' || chrom || ':' || pos AS variant_id, row_number() OVER (ORDER BY variant_idx) - 1 AS ld_row FROM g",
    "ld_block_assembly": ctes("a")
    + """, c AS (SELECT DISTINCT variant_idx FROM a WHERE variant_idx IN (SELECT variant_idx FROM variants)), e AS (SELECT row_idx, col_idx, max(r2) AS r2 FROM ld_blocks WHERE r2 >= 0 AND r2 <= 1 AND row_idx <> col_idx GROUP BY 1, 2),
      q AS (SELECT row_idx, col_idx, greatest(r2 * 499 / 498 - 1.0 / 498, 0) AS r2 FROM e WHERE r2 >= 0.02 AND row_idx IN (SELECT * FROM c) AND col_idx IN (SELECT * FROM c))
      SELECT row_idx, col_idx, round(r2, 6) AS r2 FROM q WHERE r2 >= 0.02""",
    "source_link_scan": ctes("l") + " SELECT s AS pos, gene, CAST(score AS DOUBLE) AS score FROM l WHERE chrom = 3 AND score >= 0.05",
    "prepared_partition_scan": ctes("l") + " SELECT s AS pos, gene, cell_type AS mechanism, round(CAST(CAST(score AS FLOAT) AS DOUBLE), 6) AS score FROM l WHERE chrom = 2 AND CAST(score AS FLOAT) >= 0.05::DOUBLE",
    "gtf_scan": """WITH x AS (SELECT 'E' || (p_partkey % 500) AS ensembl, p_partkey, row_number() OVER (PARTITION BY p_partkey % 500 ORDER BY p_partkey) AS nr FROM part WHERE p_partkey % 3 <> 0)
      SELECT ensembl, CASE WHEN p_partkey % 5 > 0 THEN 'N' || p_partkey ELSE ensembl END AS symbol FROM x WHERE nr = 1""",
    "target_scan": """WITH x AS (SELECT 'E' || (s_suppkey % 40) AS ensembl, 'S' || s_suppkey AS symbol, s_suppkey % 7 AS n FROM supplier), y AS (SELECT *, row_number() OVER (PARTITION BY ensembl ORDER BY n DESC, symbol DESC) AS nr FROM x)
      SELECT ensembl, symbol, n AS nominations FROM y WHERE nr = 1""",
    "extracted_scan": ctes("vv") + " SELECT chrom AS CHR, pos AS BP, marker AS SNP, 'G' AS A1, 'A' AS A2, round(z / 10, 6) AS BETA, CASE WHEN event_id % 7 > 0 THEN event_id % 7 ELSE event_id % 50 END AS N FROM v WHERE isfinite(z) AND (event_id % 7 > 0 OR event_id % 50 > 0)",
    "study_preparation": ctes("vv") + " SELECT chrom, pos + 10 AS pos, marker AS snp, round(z, 5) AS z, 2 * (event_id % 9) AS n FROM v WHERE isfinite(z) AND event_id % 11 <> 0 AND event_id % 9 > 0 AND chrom % 2 = 0",
    "link_loader": _NV
    + """, o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(1 + l_suppkey % 22 AS INT) AS chrom, (l_orderkey * 7919 + l_linenumber * 104729) % 2592000 AS s, CAST(trunc(l_quantity) AS BIGINT) AS q, 'G' || l_partkey AS gene, l_returnflag AS cell, l_discount AS score FROM lineitem),
      k AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, s, q, score, gene) AS nr FROM o WHERE score >= 0.015 AND chrom IN (SELECT chrom FROM nv)),
      gi AS (SELECT gene, row_number() OVER (ORDER BY min(nr)) - 1 AS gene_idx FROM k GROUP BY 1), mi AS (SELECT cell, row_number() OVER (ORDER BY min(nr)) AS mechanism_idx FROM k GROUP BY 1),
      h AS (SELECT variant_idx, gene, cell, max(score) AS v FROM nv JOIN k ON nv.chrom = k.chrom AND nv.pos BETWEEN k.s AND k.s + k.q * 20 GROUP BY ALL)
      SELECT gene_idx, gene, CAST(mechanism_idx AS INT) AS mechanism_idx, count(*) AS n, round(sum(v), 4) AS value FROM h JOIN gi USING (gene) JOIN mi USING (cell) GROUP BY ALL
      UNION ALL SELECT gene_idx, gene, 0, count(DISTINCT variant_idx), round(CAST(count(DISTINCT variant_idx) AS DOUBLE), 4) FROM h JOIN gi USING (gene) GROUP BY ALL""",
    "peak_context_loader": _NV
    + f", w AS (SELECT nv.variant_idx, {_FLAG} FROM nv LEFT JOIN p ON nv.chrom = p.chrom AND nv.pos BETWEEN p.s AND p.e GROUP BY 1) SELECT variant_idx, CAST(greatest({', '.join(_P)}) AS INT) AS intercept, {', '.join(f'CAST({c} AS INT) AS {c}' for c in _P)} FROM w",
    "peak_gene_loader": _NV
    + """, i AS (SELECT DISTINCT variant_idx, nv.chrom, pos, CAST(substr(context, 1, 1) AS INT) AS m FROM nv JOIN p ON nv.chrom = p.chrom AND nv.pos BETWEEN p.s AND p.e),
      h AS (SELECT DISTINCT variant_idx, gene, m FROM i JOIN t ON i.chrom = t.chrom AND i.m = t.context_idx + 1 AND abs(i.pos - t.tss) <= 20000), gi AS (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS gene_idx FROM (SELECT DISTINCT gene FROM t))
      SELECT gene_idx, gene, CAST(m AS INT) AS mechanism_idx, count(*) AS n FROM h JOIN gi USING (gene) GROUP BY ALL UNION ALL SELECT gene_idx, gene, 0, count(DISTINCT variant_idx) FROM h JOIN gi USING (gene) GROUP BY ALL""",
    "predicted_loader": _NV
    + """, k AS (SELECT v.chrom, v.pos, 'G' || p_partkey AS gene, event_id % 3 AS m, 0.85::DOUBLE + (event_id % 10)::DOUBLE / 100 AS score FROM v JOIN part ON event_id % 200 = p_partkey),
      h AS (SELECT variant_idx, nv.chrom, gene, m, max(score) AS v FROM k JOIN nv USING (chrom, pos) WHERE score >= 0.9::DOUBLE GROUP BY ALL), gi AS (SELECT gene, row_number() OVER (ORDER BY min(chrom), gene) - 1 AS gene_idx FROM h GROUP BY 1)
      SELECT gene_idx, gene, CAST(m + 1 AS INT) AS mechanism_idx, count(*) AS n, round(sum(v), 4) AS value FROM h JOIN gi USING (gene) GROUP BY ALL
      UNION ALL SELECT gene_idx, gene, 0, count(DISTINCT variant_idx), round(CAST(count(DISTINCT variant_idx) AS DOUBLE), 4) FROM h JOIN gi USING (gene) GROUP BY ALL""",
    "association_loader": ctes("vv")
    + """, k AS (SELECT 'E' || (event_id % 500) AS gene, chrom, pos, event_id % 2 AS m, z FROM v WHERE isfinite(z) AND z * z > 0), tg AS (SELECT gene FROM k GROUP BY 1 ORDER BY max(abs(z)) DESC, gene LIMIT 100),
      h AS (SELECT chrom, pos, gene, m, max(z * z) AS v FROM k WHERE gene IN (SELECT gene FROM tg) GROUP BY ALL), gi AS (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS gene_idx FROM (SELECT DISTINCT gene FROM h))
      SELECT gene_idx, gene, CAST(m + 1 AS INT) AS mechanism_idx, count(*) AS n, round(sum(v), 4) AS value FROM h JOIN gi USING (gene) GROUP BY ALL
      UNION ALL SELECT gene_idx, gene, 0, count(*), round(CAST(count(*) AS DOUBLE), 4) FROM (SELECT DISTINCT chrom, pos, gene FROM h) JOIN gi USING (gene) GROUP BY ALL""",
    "annotation_files": ctes("vv", "p") + f" SELECT v.chrom AS CHR, v.pos AS BP, marker AS SNP, {', '.join(f'CAST({x} AS INT) AS {x}' for x in _P)} FROM (SELECT event_id, {_FLAG} FROM v LEFT JOIN p ON v.chrom = p.chrom AND v.pos BETWEEN p.s AND p.e GROUP BY 1) JOIN v USING (event_id)",
    "predicted_annotation_files": ctes("vv")
    + """, k AS (SELECT chrom, pos, event_id % 3 AS m, max(0.85::DOUBLE + (event_id % 10)::DOUBLE / 100) AS s FROM v WHERE 0.85::DOUBLE + (event_id % 10)::DOUBLE / 100 >= 0.9::DOUBLE GROUP BY ALL)
      SELECT v.chrom AS CHR, v.pos AS BP, marker AS SNP, round(coalesce(sum(3 * s) FILTER (WHERE m = 0), 0), 4) AS m0, round(coalesce(sum(3 * s) FILTER (WHERE m = 1), 0), 4) AS m1, round(coalesce(sum(3 * s) FILTER (WHERE m = 2), 0), 4) AS m2
      FROM v LEFT JOIN k USING (chrom, pos) GROUP BY ALL""",
    "ldsc_reference_m": _CS
    + " SELECT chrom AS CHR, CAST(count(DISTINCT g.variant_idx) AS DOUBLE) AS base, " + ", ".join(f"round(coalesce(sum(v) FILTER (WHERE mechanism_idx = {c}), 0), 4) AS L{c}" for c in CONTEXTS) + " FROM g LEFT JOIN cs USING (variant_idx) GROUP BY 1",
    "ldsc_reference_files": _CS
    + """, b AS (SELECT row_idx AS variant_idx, sum(r2) AS base FROM ld GROUP BY 1), x AS (SELECT row_idx AS variant_idx, sum(r2 * v) FILTER (WHERE mechanism_idx = 1) AS l1, sum(r2 * v) FILTER (WHERE mechanism_idx = 9) AS l9 FROM ld JOIN cs ON ld.col_idx = cs.variant_idx GROUP BY 1)
      SELECT chrom AS CHR, 'v' || variant_idx AS SNP, pos AS BP, round(base, 5) AS base, round(coalesce(l1, 0), 5) AS L1, round(coalesce(l9, 0), 5) AS L9, round(coalesce(c1.v, 0), 5) AS a1, round(base, 5) AS weight
      FROM g JOIN b USING (variant_idx) LEFT JOIN x USING (variant_idx) LEFT JOIN (SELECT variant_idx, v FROM cs WHERE mechanism_idx = 1) c1 USING (variant_idx)""",
    "sumstats_file": ctes("vv") + " SELECT marker AS SNP, 1000 AS N, round(z, 6) AS Z FROM v",
    "lifted_links": ctes("l")
    + """, q AS (SELECT *, coalesce(e <= 2000000, false) AND s < e AS ok, CASE WHEN chrom % 2 = 0 THEN s + 500 ELSE 500 + 2000000 - e END AS ns FROM l)
      SELECT cell_type, count(*) AS input_rows, count(*) FILTER (WHERE ok) AS mapped_rows, count(*) FILTER (WHERE NOT ok) AS unmapped_rows, CAST(sum(ns) FILTER (WHERE ok) AS BIGINT) AS starts, CAST(sum(e - s) FILTER (WHERE ok) AS BIGINT) AS length FROM q GROUP BY 1""",
    "expressed_starts": ctes("t") + " SELECT DISTINCT chrom, tss + 500 AS tss, gene, 'c' || context_idx AS cell_type FROM t WHERE context_idx % 2 = 0 AND tss <= 2000000",
    "marker_identity": ctes("g") + " SELECT min(variant_idx) AS variant_idx, 'rs' || min(variant_idx) AS SNP, 'A' AS A1, 'C' AS A2, min(chrom) AS CHR, min(pos) AS BP FROM g GROUP BY variant_id",
    "fold_cache": """WITH x AS (SELECT variant_idx, max(cv_groups) AS cv_groups, max(cv_score_groups) AS cv_score_groups, row_number() OVER (ORDER BY variant_idx) - 1 AS k FROM cv_folds GROUP BY 1)
      SELECT cv_groups, cv_score_groups, count(*) AS n, CAST(sum(k) AS BIGINT) AS ids, true AS whole FROM x GROUP BY ALL""",
    "table_cache": ctes("vv") + " SELECT count(*) AS n, min(pos) AS min_pos, max(pos) AS max_pos, max(event_id) AS max_id FROM v",
    "run_files": ctes("a")
    + """, m AS (SELECT mechanism_idx AS c, sum(value) AS m FROM a WHERE mechanism_idx BETWEEN 1 AND 9 GROUP BY 1)
      SELECT t.name AS trait, 'c' || c AS context, round(f * coalesce(m, 0), 6) AS effect, round(3 * f * coalesce(m, 0), 6) AS coefs, 0.5::DOUBLE AS tau FROM (VALUES ('one', 1.0::DOUBLE), ('two', 2.0::DOUBLE)) t(name, f), range(1, 10) r(c) LEFT JOIN m USING (c)""",
    "stream_annotation": ctes("vv", "p") + " SELECT v.chrom, context, count(*) AS n, CAST(sum(pos) AS BIGINT) AS positions FROM v JOIN p ON v.chrom = p.chrom AND v.pos BETWEEN p.s AND p.e GROUP BY ALL",
}
