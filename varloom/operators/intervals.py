"""Continuous periods and gaps of overlapping intervals, safe for entities of any size.

The textbook plan is one window per entity: sort by start, compare each start with the running
maximum of the ends before it, number the islands with a cumulative sum, aggregate. An entity that
holds a third of all rows would be one task. Here every entity is cut into tiles of the axis and the
window runs per tile. What crosses a tile's edge (the furthest end so far and the start of the
island that is still open) travels through one summary row per tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import Scratch

#: Width of a tile. An entity has at most this many distinct starts in one tile.
TILE = 1 << 20


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _rows(df: DataFrame, entity: list[str | Column], start: str | Column, end: str | Column, tile: int) -> DataFrame:
    """``k, r``: the entity as a struct, and a struct of kind and bounds."""
    # a struct key: null entity values are equal to each other in groups, windows and joins
    base = (
        df.select(F.struct(*[_col(e).alias(f"e{i}") for i, e in enumerate(entity)]).alias("k"), _col(start).cast("long").alias("s"), _col(end).cast("long").alias("e"))
        .where("s < e")
        .groupBy("k", "s")
        .agg(F.max("e").alias("e"))
        .withColumn("tile", F.floor(F.col("s") / F.lit(tile)).cast("long"))
    )
    by_tile = W.partitionBy("k", "tile").orderBy("s")
    before = by_tile.rowsBetween(W.unboundedPreceding, -1)
    upto = by_tile.rowsBetween(W.unboundedPreceding, 0)
    # islands within a tile: at most one row per island is left
    reach = F.max("e").over(before)
    local = (
        base.withColumn("fresh", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0))
        .withColumn("island", F.sum("fresh").over(upto))
        .groupBy("k", "tile", "island")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
    )
    scratch = Scratch(df.sparkSession, "periods")
    local = scratch.stage(local)  # read twice below, made once
    # per tile, what earlier tiles hand over: the furthest end, and the start of the last island that began
    earlier = W.partitionBy("k").orderBy("tile").rowsBetween(W.unboundedPreceding, -1)
    hand = (
        local.groupBy("k", "tile").agg(F.max("s").alias("last_s"), F.max("e").alias("last_e"))
        .withColumn("far", F.max("last_e").over(earlier))
        .withColumn("began", F.when(F.col("far").isNull() | (F.col("last_s") > F.col("far")), F.col("last_s")))
        .withColumn("open", F.max("began").over(earlier))
        .select("k", "tile", "far", "open")
    )
    x = local.join(hand, ["k", "tile"])
    # a head begins a period; the gap before it starts where everything earlier ends
    x = (
        x.withColumn("ended", F.greatest("far", F.max("e").over(before)))
        .withColumn("head", F.col("ended").isNull() | (F.col("s") > F.col("ended")))
        .withColumn("label", F.coalesce(F.max(F.when(F.col("head"), F.col("s"))).over(upto), F.col("open")))
        .groupBy("k", "label")
        .agg(F.max("e").alias("e"), F.max(F.when(F.col("head"), F.col("ended"))).alias("gap_from"))
    )
    rows = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("label").alias("a"), F.col("e").alias("b")),
        F.struct(F.lit("gap").alias("kind"), F.col("gap_from").alias("a"), F.col("label").alias("b")),
    )
    return x.select("k", F.explode(rows).alias("r")).where("r.a is not null")


def periods_and_gaps(
    df: DataFrame, entity: list[str | Column], start: str | Column, end: str | Column, names: list[str], tile: int = TILE
) -> DataFrame:
    """``names..., kind ('period' or 'gap'), from_pos, to_pos`` of each entity's half-open intervals.

    Intervals that overlap, nest or touch (end = start) are one period; a gap reaches from a
    period's end to the next one's start in the same entity. Rows with a null bound or
    ``start >= end`` carry no position and are left out; null entity values form an entity of their
    own. Repeated rows count once. An empty input gives an empty result. Only the named columns are
    read, so other columns may have any name.
    """
    keys = [F.col(f"k.e{i}").alias(n) for i, n in enumerate(names)]
    return _rows(df, entity, start, end, tile).select(*keys, F.col("r.kind").alias("kind"), F.col("r.a").alias("from_pos"), F.col("r.b").alias("to_pos"))


def merge_periods(df: DataFrame, entity: list[str | Column], start: str | Column, end: str | Column, names: list[str], tile: int = TILE) -> DataFrame:
    """Only the periods: ``names..., from_pos, to_pos``."""
    keys = [F.col(f"k.e{i}").alias(n) for i, n in enumerate(names)]
    return _rows(df, entity, start, end, tile).where("r.kind = 'period'").select(*keys, F.col("r.a").alias("from_pos"), F.col("r.b").alias("to_pos"))


def running_max(df: DataFrame, entity: list[str], start: str, end: str, out: str, tile: int = TILE) -> DataFrame:
    """``df`` with the furthest end so far in the order of start, then end: per tile, with what earlier tiles hand over."""
    x = df.withColumn("_tile", F.floor(F.col(start) / F.lit(tile)).cast("long"))
    earlier = W.partitionBy(*entity).orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)
    hand = x.groupBy(*entity, "_tile").agg(F.max(end).alias("_far")).withColumn("_far", F.max("_far").over(earlier))
    upto = W.partitionBy(*entity, "_tile").orderBy(start, end).rowsBetween(W.unboundedPreceding, 0)
    return x.join(hand, [*entity, "_tile"]).withColumn(out, F.greatest("_far", F.max(end).over(upto))).drop("_tile", "_far")


def autosome(c: str | Column) -> Column:
    """1..22 from a chromosome with or without ``chr`` in any case, else null (no blanks, no leading zeros)."""
    return F.regexp_extract(_col(c), r"^(?:[cC][hH][rR])?([1-9]|1[0-9]|2[0-2])$", 1).try_cast("int")
