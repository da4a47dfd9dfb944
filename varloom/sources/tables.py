"""Interval, gene, marker, link and LD tables."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import autosomal, chrom_number, strip_version, variant_id
from ..operators.index import dense_index
from ..operators.joins import assert_unique, first_per
from ..operators.sparse import squared


#: Columns that give the order of a file's lines.
LINE = ["_file", "_block", "_line"]


def lines(df: DataFrame) -> DataFrame:
    """A file scan with the place of every row: file, start of the split, and row within it. A file of many splits needs no single reader."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))


def read_bed(spark: SparkSession, path: str, required: bool = False) -> DataFrame:
    """``chrom, start, end`` of the autosomes from the first three columns; ``required`` refuses an empty result."""
    raw = spark.read.text(path)
    f = F.split("value", r"\t")
    out = raw.select(chrom_number(f[0]).alias("chrom"), F.get(f, F.lit(1)).try_cast("long").alias("start"), F.get(f, F.lit(2)).try_cast("long").alias("end"))
    out = out.where(autosomal("chrom") & (F.col("end") > F.col("start")))
    if required and out.isEmpty():
        raise ValueError(f"{path} has no autosomal interval")
    return out


def read_tss(spark: SparkSession, path: str, contexts: list[str]) -> DataFrame:
    """``chrom, tss, gene, context``, each once; every context asked for must occur."""
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    out = df.select(chrom_number("chrom").alias("chrom"), F.col("tss").try_cast("long").alias("tss"), "gene", F.col("CellType").alias("context"))
    out = out.where(autosomal("chrom") & (F.col("tss") > 0) & F.col("context").isin(contexts)).dropDuplicates()
    have = {r["context"] for r in out.select("context").distinct().collect()}
    if missing := sorted(set(contexts) - have):
        raise ValueError(f"contexts without a gene start: {missing}")
    return out


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, snp, cm, pos, a1, a2, bim_row`` in file order; a repeated marker is an error."""
    f = F.split(F.trim("value"), r"\s+")
    x = lines(spark.read.text(path)).where(F.trim("value") != "")
    x = x.select(f[0].cast("int").alias("chrom"), f[1].alias("snp"), f[2].cast("double").alias("cm"), f[3].cast("long").alias("pos"), f[4].alias("a1"), f[5].alias("a2"), *LINE)
    return assert_unique(dense_index(x, [F.col(c) for c in LINE], "bim_row").drop(*LINE), ["snp"])


def read_links(spark: SparkSession, path: str, score: str = "ABC.Score", ordered: bool = False) -> DataFrame:
    """``chrom, start, end, gene, score, cell_type, is_self_promoter`` of scored links; a missing flag is null. ``ordered`` adds the lines' places."""
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    df = lines(df) if ordered else df
    flag = F.col("isSelfPromoter") if "isSelfPromoter" in df.columns else F.lit(None).cast("string")
    out = df.select(chrom_number("chr").alias("chrom"), F.col("start").try_cast("long").alias("start"), F.col("end").try_cast("long").alias("end"), F.col("TargetGene").alias("gene"), F.col(f"`{score}`").try_cast("double").alias("score"), F.col("CellType").alias("cell_type"), flag.alias("is_self_promoter"), *(LINE if ordered else []))
    return out.where(autosomal("chrom"))


def compact_links(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Links of one directory per cell, the cell's name in place of the stored one; self-promoters are kept with their flag."""
    out = None
    for cell, path in files.items():
        x = read_links(spark, path).withColumn("cell_type", F.lit(cell))
        out = x if out is None else out.unionByName(x)
    return out


def read_source_links(spark: SparkSession, root: str, chrom: int, least: float) -> DataFrame:
    """``pos, gene, score`` of one chromosome of links partitioned by ``chr`` (``chr=chr1``); partition and probability reach the scan."""
    df = spark.read.schema("pos long, gene_id string, pred_prob double, chr string").parquet(root)
    return df.where((F.col("chr") == f"chr{chrom}") & (F.col("pred_prob") >= least)).select("pos", F.col("gene_id").alias("gene"), F.col("pred_prob").alias("score"))


def read_predicted(spark: SparkSession, root: str, chrom: int, least: float) -> DataFrame:
    """``pos, gene, mechanism, score`` of one chromosome's partition (the filter reaches the scan); none if it is missing."""
    schema = "pos long, gene string, mechanism string, score float, chrom short"
    try:
        df = spark.read.schema(schema).parquet(root).where(F.col("chrom") == chrom)
        df.schema  # noqa: B018
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df = spark.createDataFrame([], schema)
    return df.where(F.col("score") >= least).select("pos", "gene", "mechanism", "score")


def read_gtf_symbols(spark: SparkSession, path: str) -> DataFrame:
    """``ensembl, symbol`` of the gene rows, version stripped; a gene's first row in the file counts."""
    t = lines(spark.read.text(path)).where(F.get(F.split("value", "\t"), F.lit(2)) == "gene")
    g = t.select(strip_version(F.regexp_extract("value", r'gene_id "([^"]+)"', 1)).alias("ensembl"), F.regexp_extract("value", r'gene_name "([^"]+)"', 1).alias("symbol"), *LINE)
    g = g.withColumn("symbol", F.when(F.col("symbol") == "", F.col("ensembl")).otherwise(F.col("symbol")))
    return first_per(g, ["ensembl"], [F.col(c) for c in LINE]).select("ensembl", "symbol")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """``ensembl, symbol, nominations`` of an ``items`` export, a gene once."""
    df = spark.read.json(path, multiLine=True).select(F.explode("items").alias("i")).select("i.*")
    if missing := {"ensembl_gene_id", "hgnc_symbol", "total_nominations"} - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    t = df.select(strip_version("ensembl_gene_id").alias("ensembl"), F.col("hgnc_symbol").alias("symbol"), F.col("total_nominations").cast("long").alias("nominations"))
    return t.groupBy("ensembl").agg(F.max_by("symbol", F.struct("nominations", "symbol")).alias("symbol"), F.max("nominations").alias("nominations"))


def read_ld_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``snp, chrom, pos, a1, a2, variant_id, ld_row`` in file order; missing columns are an error."""
    names = {"rsid": "snp", "chromosome": "chrom", "position": "pos", "allele1": "a1", "allele2": "a2"}
    text = spark.read.text(path)
    head = text.first()["value"].split()
    if missing := set(names) - set(head):
        raise ValueError(f"missing columns: {sorted(missing)}")
    f = F.split(F.trim("value"), r"\s+")
    x = lines(text).where((F.trim("value") != "") & (F.size(f) == len(head)) & (f[head.index("rsid")] != "rsid"))
    x = x.select(*[f[head.index(c)].cast({"chrom": "int", "pos": "long"}.get(n, "string")).alias(n) for c, n in names.items()], *LINE)
    out = dense_index(x.withColumn("variant_id", variant_id("chrom", "pos")), [F.col(c) for c in LINE], "ld_row")
    return out.select("snp", "chrom", "pos", "a1", "a2", "variant_id", "ld_row")


def read_npz_edges(spark: SparkSession, path: str) -> DataFrame:
    """``block, row_idx, col_idx, r`` of compressed-sparse-row matrices in ``.npz`` files (indptr, indices, data)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                z = np.load(io.BytesIO(c), allow_pickle=False)
                ptr, idx, val = z["indptr"], z["indices"], z["data"]
                step = 1_000_000
                rows = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
                for i in range(0, len(idx), step):
                    yield pd.DataFrame({"block": p.rsplit("/", 1)[-1].removesuffix(".npz"), "row_idx": rows[i : i + step], "col_idx": idx[i : i + step].astype("int64"), "r": val[i : i + step].astype("float64")})

    return files.mapInPandas(run, "block string, row_idx long, col_idx long, r double")


def ld_block_edges(edges: DataFrame, meta: DataFrame, chosen: DataFrame, cut: float, n: int | None = None) -> DataFrame:
    """``row_idx, col_idx, r2`` of the chosen variants (``ld_row, variant_idx``) of a block's correlations, squared, adjusted and cut."""
    keep = chosen.join(meta.select("ld_row"), "ld_row", "left_semi").select("ld_row", "variant_idx")
    x = edges.join(keep.select(F.col("ld_row").alias("row_idx"), F.col("variant_idx").alias("_a")), "row_idx")
    x = x.join(keep.select(F.col("ld_row").alias("col_idx"), F.col("variant_idx").alias("_b")), "col_idx")
    return squared(x.select(F.col("_a").alias("row_idx"), F.col("_b").alias("col_idx"), "r"), "r", cut, n).select("row_idx", "col_idx", "r2")
