"""Coordinates mapped between assemblies through ungapped alignment blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .joins import range_join, unique_keys

BLOCKS = "chrom string, start long, end long, to_chrom string, to_start long, forward boolean"


def chain_blocks(text: str) -> list[tuple[str, int, int, str, int, bool]]:
    """Ungapped blocks of a chain text: half-open source ranges with the target start (of the block's low end) and strand.

    A ``chain`` line names both sequences, their sizes, strands and ranges; each further line holds a
    block's size and, but for the last, the gaps that follow in source and target.
    """
    out, head = [], None
    for line in text.splitlines():
        f = line.split()
        if not f or f[0].startswith("#"):
            continue
        if f[0] == "chain":
            head, at, to = f, int(f[5]), int(f[10])
            continue
        size = int(f[0])
        forward = head[9] == "+"
        low = to if forward else int(head[8]) - to - size
        out.append((head[2], at, at + size, head[7], low, forward))
        if len(f) == 3:
            at, to = at + size + int(f[1]), to + size + int(f[2])
    return out


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of chain files, each file parsed whole in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b["value"]:
                yield pd.DataFrame(chain_blocks(t), columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return spark.read.text(path, wholetext=True).mapInPandas(run, BLOCKS)


def lift(points: DataFrame, blocks: DataFrame, key: str, chrom: str = "chrom", pos: str = "pos", same_chrom: bool = True) -> DataFrame:
    """``key, to_chrom, to_pos`` of the points that map once, to a coordinate that no other point maps to.

    Positions are counted from the start of a half-open block; on the reverse strand from its end.
    """
    p = points.select(F.col(key), F.col(chrom).alias("_c"), F.col(pos).alias("_p"))
    b = blocks.select(F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"), "to_chrom", "to_start", "forward")
    m = range_join(p, b, ["_c"], "_p", "_s", "_e", half_open=True)
    if same_chrom:
        m = m.where(F.col("_c") == F.col("to_chrom"))
    to = F.col("to_start") + F.when(F.col("forward"), F.col("_p") - F.col("_s")).otherwise(F.col("_e") - 1 - F.col("_p"))
    once = unique_keys(m.select(key, "to_chrom", to.alias("to_pos")), [key])
    return unique_keys(once, ["to_chrom", "to_pos"])
