"""Score cutoffs that keep a target fraction of each source, by iterative histogram refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import Scratch
from .topn import finite

#: Bins of one histogram.
BINS = 1024
#: Sources up to which their state is broadcast (about 100 bytes each); above, the join is shuffled with salt.
BROADCAST_ROWS = 100_000
SALTS = 16


def _beside(rows: DataFrame, state: DataFrame, n: int, on: str, spread: str) -> DataFrame:
    """``rows`` with each one's ``state``: broadcast where ``n`` is small enough, else salted, so that a hot source spreads."""
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(state), on)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    copies = state.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("_salt", F.col("_salt").cast("long"))
    return salted.join(copies, [on, "_salt"]).drop("_salt")


def best_records(df: DataFrame, source: str, record: Column, score: str, extra: str) -> DataFrame:
    """``source, record, score``, one row a record, with the source's ``extra`` (its smallest non-null value) in a second table's place.

    A record's score is its highest finite one in the source.
    """
    return (
        df.select(F.col(source).alias("source"), record.alias("record"), F.col(score).cast("double").alias("score"), F.col(extra).alias("extra"))
        .where(F.col("record").isNotNull() & (F.col("record") != "") & F.col("source").isNotNull() & finite(F.col("score")))
        .groupBy("source", "record")
        .agg((F.max("score") + F.lit(0.0)).alias("score"), F.min("extra").alias("extra"))
    )


def cutoffs(scratch: Scratch, records: DataFrame, wanted: DataFrame, bins: int = BINS) -> DataFrame:
    """``source, n, k, cutoff``: the score of number ``k`` in descending order of each source.

    ``records`` is ``source, record, score`` with finite scores, ``wanted`` is ``source, n, k, lo,
    hi`` with 1 <= k <= n and the bounds of the source's scores. Each round counts the scores that
    lie within the bounds into bins, takes the bin that holds the target rank, and sets the bounds
    to the smallest and largest score in it. As the outer bins hold the bounds themselves, a round
    always separates two different scores; it ends when both bounds are the cutoff.
    """
    state = scratch.stage(wanted.select("source", "n", "k", F.col("k").alias("rank"), "lo", "hi"))
    done = []
    while True:
        done.append(state.where("lo = hi").select("source", "n", "k", F.col("lo").alias("cutoff")))
        left = state.where("lo < hi")
        n = left.count()
        if not n:
            break
        # halves keep the width finite for bounds near the ends of the double range
        place = (F.col("score") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        fine = F.when(F.col("hi") / 2 > F.col("lo") / 2, F.least(F.lit(bins - 1), F.floor(place * bins))).otherwise(F.when(F.col("score") > F.col("lo"), bins - 1).otherwise(0))
        within = _beside(records, left, n, "source", "record").where(F.col("score").between(F.col("lo"), F.col("hi")))
        hist = within.groupBy("source", fine.cast("int").alias("bin")).agg(
            F.count(F.lit(1)).alias("c"), F.min("score").alias("blo"), F.max("score").alias("bhi"),
            F.first("n").alias("n"), F.first("k").alias("k"), F.first("rank").alias("rank"),
        )
        above = F.sum("c").over(W.partitionBy("source").orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, 0))
        hit = hist.withColumn("above", above).where((F.col("above") >= F.col("rank")) & (F.col("above") - F.col("c") < F.col("rank")))
        nxt = scratch.stage(hit.select("source", "n", "k", (F.col("rank") - (F.col("above") - F.col("c"))).alias("rank"), F.col("blo").alias("lo"), F.col("bhi").alias("hi")))
        state = nxt
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def keep_fraction(df: DataFrame, targets: DataFrame, source: str, panel: str, record: Column, score: str, target_panel: str = "panel", permille: str = "keep_permille", bins: int = BINS) -> tuple[DataFrame, DataFrame]:
    """The cutoffs (``source, n, k, cutoff, kept``) and the kept records (``source, record, score``).

    Of a source's ``n`` records the cutoff is the score of number ``ceil(n * permille / 1000)`` in
    descending order, and every record at or above it is kept, ties included, so ``kept`` may exceed
    ``k``. A share of zero keeps nothing and gives no cutoff; shares above 1000 keep all. Records
    are non-empty and have a finite score; repeated ones count once with their highest score. A
    source belongs to its (smallest) panel; a source whose panel has no target gives no row. Empty
    inputs give empty results.
    """
    scratch = Scratch(df.sparkSession, "cutoff")
    records = scratch.stage(best_records(df, source, record, score, panel))
    per = records.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.min("extra").alias("extra"))
    t = targets.select(F.col(target_panel).alias("extra"), F.col(permille).cast("long").alias("share")).groupBy("extra").agg(F.max("share").alias("share"))
    k = F.least(F.col("n"), F.expr("(n * share + 999) div 1000"))
    wanted = per.join(t, "extra").withColumn("k", k).where("k >= 1")
    records = records.select("source", "record", "score")
    cut = scratch.stage(cutoffs(scratch, records, wanted, bins))
    n = cut.count()
    kept = _beside(records, cut.select("source", "cutoff"), n, "source", "record").where("score >= cutoff").select("source", "record", "score")
    sizes = kept.groupBy("source").agg(F.count(F.lit(1)).alias("kept"))
    return cut.join(sizes, "source", "left").select("source", "n", "k", "cutoff", "kept"), kept
