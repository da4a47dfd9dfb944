"""Registered queries of the training-data operators; their SQL is in ``sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import table
from . import sql
from .bpe import decode_ids, encode_texts
from .components import connected_components
from .cutoff import keep_fraction
from .language import language_segments, wrong_labels
from .leaks import cleaned_documents, leaked_spans
from .splits import assign_splits, broken_families, families, with_untied
from .topn import top_n

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = top_n(table(spark, d, "rankings"), ["source", "analysis"], F.substring_index("ensembl", ".", 1), "score", 10)
    return out.select("source", "analysis", "rank", F.col("item").alias("ensembl"))


def _splits(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "annotation_triples")
    return assign_splits(with_untied(families(t), t), "family_idx", SHARES)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Members of the families, as they were put into splits, whose stored folds part them."""
    return broken_families(_splits(spark, d), table(spark, d, "cv_folds"))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every variant and gene with its family and split; one that no row ties to another is a family of its own."""
    return _splits(spark, d).drop("bin")


def p2_bins(spark: SparkSession, d: str) -> DataFrame:
    """What the bins must keep: members and families, families in more than one split or bin, and whether each split is within the heaviest bin of its share."""
    s = _splits(spark, d)
    fam = s.groupBy("family_idx").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("split").alias("splits"), F.countDistinct("bin").alias("bins"))
    fam = fam.agg(F.sum("n").alias("n_members"), F.count(F.lit(1)).alias("n_families"), F.count_if(F.col("splits") > 1).alias("n_parted"), F.count_if(F.col("bins") > 1).alias("n_torn"))
    bins = s.groupBy("bin", "split").agg(F.count(F.lit(1)).alias("w"))
    sizes = bins.groupBy("split").agg(F.sum("w").alias("w"), F.max("w").alias("top"))
    share = F.create_map(*[F.lit(x) for kv in SHARES.items() for x in kv])[F.col("split")]
    whole = W.partitionBy()  # three rows
    near = sizes.select((F.abs(F.col("w") - share * F.sum("w").over(whole)) <= F.max("top").over(whole)).alias("near"))
    return fam.join(F.broadcast(near.agg(F.count(F.lit(1)).alias("n_splits"), F.count_if("near").alias("n_near"))), F.lit(True))  # one row each


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    ld = table(spark, d, "ld_blocks").where((F.col("r2") >= 0.01) & (F.col("r2") <= 1.0))
    return connected_components(ld, "row_idx", "col_idx").select("group_idx", F.col("id").alias("variant_idx"))


def _cut(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return keep_fraction(table(spark, d, "rankings"), table(spark, d, "keep_targets"), "source", "panel", F.upper(F.regexp_replace("symbol", r"^\s+|\s+$", "")), "score")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d)[1].select("source", F.col("record").alias("symbol"))


def p6_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """Each source's cutoff and kept size."""
    return _cut(spark, d)[0].select("source", F.col("n").alias("n_records"), F.col("k").alias("n_target"), "cutoff", F.col("kept").alias("n_kept"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Checksums of the texts that the ids decode to."""
    return decode_ids(p7_ids(spark, d)).select("doc_id", F.md5("text").alias("text_md5"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """The documents with leaks, without the leaked spans."""
    return cleaned_documents(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return wrong_labels(language_segments(table(spark, d, "documents"), table(spark, d, "lang_samples"))).select("doc_id", "segment", "lang")


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every document's stretches with their confidence."""
    s = language_segments(table(spark, d, "documents"), table(spark, d, "lang_samples"))
    return s.select("doc_id", "segment", "lang", F.round("confidence", 6).alias("confidence"), "sentences")


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_splits": p2_splits,
    "p2_bins": p2_bins,
    "p4_found": p4_found,
    "p6_found": p6_found,
    "p6_cutoffs": p6_cutoffs,
    "p7_ids": p7_ids,
    "p7_decoded": p7_decoded,
    "p8_found": p8_found,
    "p8_cleaned": p8_cleaned,
    "p9_found": p9_found,
    "p9_languages": p9_languages,
}
ORACLES = {k: v for k, v in sql.ORACLES.items() if k in QUERIES}
