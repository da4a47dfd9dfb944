"""Top N items within every group, by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def top_n(df: DataFrame, group: list[str], item: str | Column, score: str, n: int = 10, subgroups: int = 64) -> DataFrame:
    """``group..., rank, item, score``: the ``n`` best items of every group.

    An item's score is its highest finite one in the group, so repeated rows count once; items
    without a finite score and null items take no part. Order is score descending, then item
    ascending, so ranks are 1..n without ties and the same on every run. A null group value is a
    group like any other; an empty input gives an empty result; other columns are not read.

    Each group is hashed into ``subgroups`` parts by item. Every part is ranked on its own and
    keeps ``n`` (Spark cuts each map task's rows to ``n`` a part before the shuffle), then the at
    most ``n * subgroups`` survivors of a group are ranked. No task sees a whole group. The maximum has an
    exchange of its own, as only a combining aggregate keeps copies of one item from meeting in one task.
    """
    keys = [f"_g{i}" for i in range(len(group))]
    it = F.col(item) if isinstance(item, str) else item
    rows = df.select(*[F.col(g).alias(k) for g, k in zip(group, keys)], it.alias("_item"), F.col(score).cast("double").alias("_score"))
    best = (
        rows.where(F.col("_item").isNotNull() & finite(F.col("_score")))
        .groupBy(*keys, "_item")
        .agg((F.max("_score") + F.lit(0.0)).alias("_score"))  # -0.0 and 0.0 tie
        .withColumn("_part", F.pmod(F.xxhash64("_item"), F.lit(subgroups)))
    )
    order = [F.col("_score").desc(), F.col("_item").asc()]
    kept = best.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order))).where(F.col("_r") <= n)
    out = kept.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n)
    return out.select(*[F.col(k).alias(g) for g, k in zip(group, keys)], F.col("_r").cast("int").alias("rank"), F.col("_item").alias("item"), F.col("_score").alias("score"))
