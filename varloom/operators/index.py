"""Dense numbering in a global order without a single-task window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import Scratch


def dense_index(df: DataFrame, order: list[Column], out: str, scratch: Scratch | None = None) -> DataFrame:
    """``df`` with its rank 0.. by ``order``, which must be total.

    Rows are range-partitioned and written, so that a task run again sees the same rows; each
    partition numbers its own rows, and the partitions' offsets (one row a partition) are added.
    """
    scratch = scratch or Scratch(df.sparkSession, "index")  # its table goes when the application ends
    kept = scratch.stage(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = F.sum("count").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    offsets = kept.groupBy("_p").count().select("_p", F.coalesce(before, F.lit(0)).alias("_o"))
    inner = F.row_number().over(W.partitionBy("_p").orderBy(*order))
    numbered = kept.withColumn("_i", inner).join(F.broadcast(offsets), "_p")
    return numbered.withColumn(out, (F.col("_i") - 1 + F.col("_o")).cast("long")).drop("_p", "_i", "_o")


def running_sum(df: DataFrame, group: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its group up to and with this one, by ``order``, which must be total within groups.

    Rows are range-partitioned by group and order and written; a partition sums its own rows and adds what earlier partitions
    hold of the same group (one row for a group and partition), so a group of any size is spread over tasks.
    """
    scratch = Scratch(df.sparkSession, "running")
    kept = scratch.stage(df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_p", F.spark_partition_id()))
    before = F.sum("_s").over(W.partitionBy(*group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    part = kept.groupBy(*group, "_p").agg(F.sum(value).alias("_s")).select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], F.col("_p").alias("_q"), F.coalesce(before, F.lit(0)).alias("_o"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(group)], F.col("_p") == F.col("_q"))
    inner = F.sum(value).over(W.partitionBy(*group, "_p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return kept.withColumn("_i", inner).join(part, same).withColumn(out, F.col("_i") + F.col("_o")).select(*df.columns, out)
