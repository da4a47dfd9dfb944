"""Writers of annotation, LD-score, association and fit tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, functions as F

from ..operators.joins import assert_unique, left_fill
from ..stats.report import json_safe
from .files import Files


def write_annotations(bim: DataFrame, scores: DataFrame, columns: list[str], out: str) -> None:
    """One gzip table per chromosome, every marker of ``bim`` in its file order, zero where there is no score.

    ``scores`` has one row per ``snp``. A chromosome's rows are one sorted partition.
    """
    x = left_fill(bim, scores.select("snp", *columns), ["snp"], {c: 0.0 for c in columns})
    x = x.select(F.col("chrom").alias("part"), F.col("chrom").alias("CHR"), F.col("pos").alias("BP"), F.col("snp").alias("SNP"), F.col("cm").alias("CM"), "bim_row", *columns)
    x = x.repartition("part").sortWithinPartitions("part", "bim_row").drop("bim_row")
    x.write.mode("overwrite").partitionBy("part").option("header", True).option("compression", "gzip").option("sep", "\t").csv(out)


def _per_chromosome(df: DataFrame, order: list[str], out: str) -> None:
    x = df.withColumn("part", F.col("CHR")).repartition("part").sortWithinPartitions("part", *order).drop(*[c for c in order if c.startswith("_")])
    x.write.mode("overwrite").partitionBy("part").option("header", True).option("compression", "gzip").option("sep", "\t").csv(out)


def write_ldsc_reference(annotations: DataFrame, scores: DataFrame, out: str) -> None:
    """The files of an LD-score reference, one part per chromosome, rows in the order of ``_row``.

    Both tables have ``_row, CHR, SNP, BP, base`` and a column per context: the annotations themselves (base is one) and
    their LD scores. Written are ``reference`` (the scores), ``annot``, ``weights`` (the base score as ``LD_weights``), and
    ``m`` and ``m_5_50``: the sums of the *annotations* by chromosome. Marker names must be unique.
    """
    assert_unique(annotations, ["SNP"])
    cols = [c for c in annotations.columns if c not in ("_row", "CHR", "SNP", "BP")]
    _per_chromosome(scores.select("_row", "CHR", "SNP", "BP", *cols), ["_row"], f"{out}/reference")
    _per_chromosome(annotations.select("_row", "CHR", "SNP", "BP", *cols), ["_row"], f"{out}/annot")
    _per_chromosome(scores.select("_row", "CHR", "SNP", "BP", F.col("base").alias("LD_weights")), ["_row"], f"{out}/weights")
    m = annotations.groupBy("CHR").agg(*[F.sum(c).alias(c) for c in cols])
    for name in ("m", "m_5_50"):
        m.coalesce(1).write.mode("overwrite").option("header", True).option("sep", "\t").csv(f"{out}/{name}")


def name_parts(spark, root: str, pattern: str) -> list[str]:
    """Moves the one file of every ``part=N`` folder to ``pattern`` with ``{}`` replaced by N, the names that outside tools expect."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs, out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), []
    for part in fs.listStatus(path):  # one folder a chromosome
        name = part.getPath().getName()
        if name.startswith("part="):
            (f,) = [x.getPath() for x in fs.listStatus(part.getPath()) if x.getPath().getName().startswith("part-")]
            to = jvm.org.apache.hadoop.fs.Path(path, pattern.format(name.removeprefix("part=")))
            fs.rename(f, to)
            fs.delete(part.getPath(), True)
            out.append(to.getName())
    return sorted(out)


def write_sumstats(df: DataFrame, out: str, alleles: bool = False) -> None:
    """``SNP, N, Z`` (and both alleles) as one gzip text table per partition."""
    cols = ["SNP", *(["A1", "A2"] if alleles else []), "N", "Z"]
    df.select(*cols).write.mode("overwrite").option("header", True).option("compression", "gzip").option("sep", "\t").csv(out)


def write_links(df: DataFrame, out: str) -> None:
    """Links partitioned by chromosome, compressed with zstd."""
    df.repartition("chrom").write.mode("overwrite").partitionBy("chrom").option("compression", "zstd").parquet(out)


def write_json(path: str, value) -> None:
    """A JSON file, written aside and renamed, with numpy values and non-finite numbers made plain."""
    folder, name = path.rsplit("/", 1)
    Files(folder).write_json(name, json_safe(value), indent=1, sort_keys=True)


def manifest(df: DataFrame, columns: list[str]) -> dict:
    """Row count and the range of some columns, in one pass."""
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(f"min_{c}") for c in columns], *[F.max(c).alias(f"max_{c}") for c in columns]).first()
    return json_safe(r.asDict())


class TableCache:
    """Named Parquet tables under a key made of the parameters; a table is whole or absent."""

    def __init__(self, root: str, **params):
        text = json.dumps(json_safe(params), sort_keys=True)
        self.files = Files(f"{root.rstrip('/')}/{hashlib.sha1(text.encode()).hexdigest()[:12]}")
        self.folder = self.files.folder

    def get(self, spark, name: str) -> DataFrame | None:
        return spark.read.parquet(f"{self.folder}/{name}") if self.files.exists(f"{name}/_SUCCESS") else None

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return df.sparkSession.read.parquet(f"{self.folder}/{name}")


class FoldCache:
    """Fold assignments beside the arrays they belong to, named by the number of folds and the threshold.

    ``variant_idx, cv_groups, cv_score_groups`` as Parquet and the metadata as JSON, written last; a cache
    that is not there, not whole, or not of ``n_variants`` rows gives nothing.
    """

    def __init__(self, arrays: str, n_folds: int, threshold: float):
        self.files = Files(f"{arrays}.cv{n_folds}.r2ge{threshold:g}")

    def put(self, folds: DataFrame, metadata: dict) -> None:
        folds.select("variant_idx", "cv_groups", "cv_score_groups").write.mode("overwrite").parquet(f"{self.files.folder}/folds")
        self.files.write_json("metadata.json", json_safe(metadata), sort_keys=True)

    def get(self, spark, n_variants: int) -> tuple[DataFrame, dict] | None:
        try:
            meta = self.files.read_json("metadata.json")
        except ValueError:
            return None
        if meta is None or not self.files.exists("folds/_SUCCESS"):
            return None
        folds = spark.read.parquet(f"{self.files.folder}/folds")
        r = folds.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("variant_idx").alias("d"), F.min("variant_idx").alias("lo"), F.max("variant_idx").alias("hi")).first()
        whole = r.n == r.d == n_variants and (n_variants == 0 or (r.lo, r.hi) == (0, n_variants - 1))
        return (folds, meta) if whole else None
