"""Connected components of graphs whose edges never leave a region."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Edges that a task holds at once.
CHUNK = 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of an edge list, each with the smallest vertex of its component."""
    ids, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = np.arange(len(ids))
    a, b = flat[: len(u)], flat[len(u) :]
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        # labels of both ends' labels fall, then every vertex follows its label down
        for side in (label[a], label[b], a, b):
            np.minimum.at(new, side, low)
        while not np.array_equal(nxt := new[new], new):
            new = nxt
        if np.array_equal(new, label):
            return ids, ids[label]
        label = new


def _thin(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Edges of bounded chunks replaced by a star for every component, key by key."""
    held: list[pd.DataFrame] = []
    size = 0

    def flush() -> Iterator[pd.DataFrame]:
        for k, g in pd.concat(held).groupby(keys, sort=False):
            ids, low = forest(g["u"].to_numpy(), g["v"].to_numpy())
            yield pd.DataFrame({**dict(zip(keys, k if isinstance(k, tuple) else (k,))), "u": ids, "v": low})

    for b in batches:
        held.append(b)
        size += len(b)
        if size >= CHUNK:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def region_components(edges: DataFrame, keys: list[str], u: str, v: str) -> DataFrame:
    """``keys..., id, component``: the smallest vertex linked to each vertex with an edge, within its keys.

    Tasks first thin their edges to stars in bounded chunks, wherever the edges lie, so at most one
    star edge per vertex and chunk is shuffled; then each region's stars, whose number is bounded by
    its vertices, are joined up. A self-edge makes a vertex a component of its own.
    """
    e = edges.select(*keys, F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema.fields if f.name in keys)
    stars = e.mapInPandas(lambda it: _thin(it, keys), f"{kinds}, u long, v long").distinct()

    def join_up(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, low = forest(pdf["u"].to_numpy(), pdf["v"].to_numpy())
        out = pd.DataFrame({k: pdf[k].iloc[0] for k in keys} | {"id": ids, "component": low})
        return out

    return stars.groupBy(*keys).applyInPandas(join_up, f"{kinds}, id long, component long")


def sweep(pairs: DataFrame, thresholds: list[float], keys: list[str], u: str = "a", v: str = "b", r2: str = "r2") -> DataFrame:
    """``threshold, keys..., id, component`` for each threshold, from one scan of the edges."""
    at = F.array(*[F.when(F.col(r2) >= t, F.lit(float(t))) for t in thresholds])
    e = pairs.withColumn("threshold", F.explode(F.array_compact(at)))
    return region_components(e, ["threshold", *keys], u, v)


def size_summary(sizes: DataFrame, by: list[str], size: str = "size") -> DataFrame:
    """Components, singletons, largest and exact quantiles of the sizes."""
    q = lambda p: F.percentile(size, F.lit(p))
    return sizes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_components"),
        F.count_if(F.col(size) == 1).alias("n_singletons"),
        F.max(size).alias("largest"),
        q(0.5).alias("q50"),
        q(0.9).alias("q90"),
        q(0.99).alias("q99"),
    )
