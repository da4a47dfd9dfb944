"""One group identifier for every record that pairwise matches link, directly or indirectly.

Two phases, each exact on what it is given:

1. *Peeling.* Frontier breadth-first joins from the vertex of highest degree collect the giant
   component, whose vertices take its minimum as their label; its edges are anti-joined away. The walk
   ends when the frontier is empty. It also ends when the frontier has thinned out to paths (or after
   ``STEPS`` joins), since a path advances one link a join: then the edges that leave what was reached
   lead to its label, and the second phase finds the rest of the component.
2. *Minimum propagation* over the rest. Tasks first propagate minima to the end among the edges they
   hold (range-partitioned by both ends, in chunks of bounded size), which shortens paths of
   neighbouring identifiers from thousands of links to a few. Then, until no edge is left, every vertex
   takes the smallest label among its neighbours, chains of labels are shortened by pointer jumping,
   and edges are rewritten to the labels.

A vertex's label is always the smallest vertex of what it stands for, so the final label is the
component's minimum. Nothing but row counts and one vertex reach the driver; every round's tables are
written to the shared folder and removed when no longer read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import forest
from ..session import Scratch

#: Edges among which a task propagates minima at once.
CHUNK = 1_000_000
#: The walk of phase 1 stops when a frontier is smaller than this share of what is already reached, or after so many joins.
THIN, STEPS = 0.05, 12


def _contract(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        u, v = (np.concatenate(x) for x in zip(*held))
        ids, low = forest(u, v)
        keep = ids != low
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(low[keep])], names=["u", "v"])

    for batch in batches:
        u, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        held.append((u, v))
        size += len(u)
        if size >= chunk:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _jump(scratch: Scratch, hop: DataFrame) -> DataFrame:
    """``id, to`` with every chain of pointers followed to its end."""
    while True:
        a, b = hop.alias("a"), hop.alias("b")
        nxt = scratch.stage(
            a.join(b, F.col("a.to") == F.col("b.id"), "left").select(
                F.col("a.id").alias("id"), F.coalesce("b.to", "a.to").alias("to"), F.col("b.to").isNotNull().alias("moved")
            )
        )
        moved = not nxt.where("moved").isEmpty()
        scratch.drop(hop)
        hop = nxt
        if not moved:
            return hop.select("id", "to")
        path = hop._scratch_path
        hop = hop.drop("moved")
        hop._scratch_path = path


def _rewrite(edges: DataFrame, hop: DataFrame) -> DataFrame:
    """Edges between labels; inner edges vanish, repeated ones count once."""
    h = hop.select("id", "to")
    e = edges.join(h.withColumnRenamed("id", "u"), "u", "left").select(F.coalesce("to", "u").alias("u"), "v")
    e = e.join(h.withColumnRenamed("id", "v"), "v", "left").select("u", F.coalesce("to", "v").alias("v"))
    return e.where("u != v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).select("u", "v").distinct()


def _peel(scratch: Scratch, edges: DataFrame, thin: float, steps: int) -> tuple[DataFrame, bool] | None:
    """``id, to`` of the vertices reached from the one of highest degree, ``to`` being their minimum, and whether the walk came to its end."""
    degree = edges.select(F.explode(F.array("u", "v")).alias("u")).groupBy("u").count()
    top = degree.agg(F.max_by("u", F.struct("count", -F.col("u"))).alias("u")).where("u is not null")
    frontier = scratch.stage(top)
    reached, total, ended = [frontier], 1, False
    for _ in range(steps):
        # both directions of an edge, without a copy of the table
        down = edges.join(frontier, "u", "left_semi").select(F.col("v").alias("u"))
        up = edges.join(frontier.withColumnRenamed("u", "v"), "v", "left_semi").select("u")
        seen = reached[-1] if len(reached) == 1 else reached[-1].union(reached[-2])  # neighbours lie no further back
        frontier = scratch.stage(down.union(up).distinct().join(seen, "u", "left_anti"))
        n = frontier.count()
        ended = n == 0
        if ended:
            break
        reached.append(frontier)
        total += n
        if n < thin * total:
            break
    if total < 2:
        return None
    everything = reduce(DataFrame.union, reached)
    low = everything.agg(F.min("u")).first()[0]
    return scratch.stage(everything.select(F.col("u").alias("id"), F.lit(low).cast("long").alias("to"))), ended


def _without(edges: DataFrame, peeled: DataFrame, ended: bool) -> DataFrame:
    """The edges with no end in the peeled part and, where the walk did not come to its end, those that lead out of it, to its label."""
    ids = peeled.select(F.col("id").alias("u"))
    by_v = ids.withColumnRenamed("u", "v")
    outside = edges.join(ids, "u", "left_anti")
    rest = outside.join(by_v, "v", "left_anti").select("u", "v")
    if ended:
        return rest
    low = peeled.select(F.col("to").alias("x")).limit(1)
    leaves = outside.join(by_v, "v", "left_semi").select(F.col("u").alias("y"))
    leaves = leaves.union(edges.join(ids, "u", "left_semi").join(by_v, "v", "left_anti").select(F.col("v").alias("y"))).distinct()
    x = leaves.join(F.broadcast(low), F.lit(True))  # a single row
    return rest.union(x.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")))


def connected_components(pairs: DataFrame, a: str, b: str, chunk: int = CHUNK, thin: float = THIN, steps: int = STEPS) -> DataFrame:
    """``group_idx, id``: every vertex with a link, and the smallest vertex linked to it by any path.

    ``pairs`` may hold either or both directions, repeats, self-links and nulls; self-links and pairs
    with a null end are no links, and a vertex without any link gives no row. Both columns are cast
    to bigint. An empty input gives an empty result; other columns are not read.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "components")
    raw = pairs.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x != y")
    edges = scratch.stage(raw.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    maps, verts = [], []
    if (peeled := _peel(scratch, edges, thin, steps)) is not None:
        hop, ended = peeled
        maps.append(hop)
        verts.append(hop.select("id"))
        edges = _without(edges, hop, ended)
    # ranges of both ends: a vertex of very high degree spreads over many tasks
    first = edges.repartitionByRange("u", "v").sortWithinPartitions("u", "v")
    stars = scratch.stage(first.mapInArrow(lambda batches: _contract(batches, chunk), "u long, v long").distinct())
    verts += [stars.select(F.col("u").alias("id")), stars.select(F.col("v").alias("id"))]
    edges = stars
    while not edges.isEmpty():
        # u > v in every row, so the smallest neighbour below u hooks it
        hop = _jump(scratch, scratch.stage(edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("to"))))
        maps.append(hop)
        edges = scratch.stage(_rewrite(edges, hop))
    # the last round's labels are final; earlier rounds' labels are looked up in them, back to front
    final = None
    for hop in reversed(maps):
        if final is None:
            final = hop
        else:
            f = final.select(F.col("id").alias("to"), F.col("to").alias("end"))
            final = scratch.stage(hop.join(f, "to", "left").select("id", F.coalesce("end", "to").alias("to")).union(final.join(hop, "id", "left_anti")))
    if final is None:
        return spark.createDataFrame([], "group_idx long, id long")
    out = scratch.stage(reduce(DataFrame.union, verts).distinct().join(final, "id", "left").select(F.coalesce("to", "id").alias("group_idx"), "id"))
    scratch.close(out)
    return out
