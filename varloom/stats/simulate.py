"""Simulated truth and statistics, distribution-equal draws from seeded hashes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def sparse_truth(scores: DataFrame, targets: dict[int, float], fraction: float, seed: int) -> DataFrame:
    """``variant_idx, direct_h2``: in each context a random ``floor(fraction * n)`` (one at least) of the variants
    with a positive score share the target in proportion to their scores; overlaps add up.

    The draw is the lowest seeded hashes: counts by the hash's leading bits find the bin in which the
    last drawn one lies, and only within bins are rows ranked, so no task sees a whole context.
    """
    if not 0 < fraction <= 1 or any(v < 0 for v in targets.values()):
        raise ValueError("fraction must be in (0, 1], targets not negative")
    wanted = [k for k, v in targets.items() if v > 0]
    pos = scores.where(F.col("mechanism_idx").isin(wanted) & (F.col("value") > 0)).select("variant_idx", "mechanism_idx", "value")
    n = {r["mechanism_idx"]: r["n"] for r in pos.groupBy("mechanism_idx").agg(F.count(F.lit(1)).alias("n")).collect()}
    if missing := [k for k in wanted if not n.get(k)]:
        raise ValueError(f"contexts without positive scores: {missing}")
    take = {k: max(1, int(np.floor(fraction * n[k]))) for k in wanted}
    lit = lambda d, t: F.element_at(F.create_map(*[x for k, v in d.items() for x in (F.lit(k).cast("long"), F.lit(v).cast(t))]), F.col("mechanism_idx").cast("long"))
    h = pos.withColumn("_h", (uniform(seed, "mechanism_idx", "variant_idx") * (1 << 48)).cast("long"))
    order = ["_h", "variant_idx"]
    q = h.groupBy("mechanism_idx", F.shiftright("_h", 32).alias("_b")).agg(F.count(F.lit(1)).alias("c"))
    run = F.sum("c").over(W.partitionBy("mechanism_idx").orderBy("_b").rowsBetween(W.unboundedPreceding, 0))
    bins = q.withColumn("run", run).withColumn("take", lit(take, "long")).where((F.col("run") - F.col("c")) < F.col("take"))
    edge = bins.withColumn("inner", F.col("run") <= F.col("take")).withColumn("left", F.col("take") - (F.col("run") - F.col("c"))).select("mechanism_idx", "_b", "inner", "left")
    h = h.withColumn("_b", F.shiftright("_h", 32)).join(edge, ["mechanism_idx", "_b"])
    h = h.withColumn("_r", F.row_number().over(W.partitionBy("mechanism_idx", "_b").orderBy(*order))).where(F.col("inner") | (F.col("_r") <= F.col("left")))
    total = h.groupBy("mechanism_idx").agg(F.sum("value").alias("total"))
    h = h.join(F.broadcast(total), "mechanism_idx")
    return h.groupBy("variant_idx").agg(F.sum(lit(targets, "double") * F.col("value") / F.col("total")).alias("direct_h2"))


def uniform(seed: int, *key: str | Column) -> Column:
    """A number in (0, 1) from the leading 48 bits of a hash of the key, the same wherever the row lies."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def noncentral_chisq(nonc: str, seed: int, key: list[str]) -> Column:
    """A draw with one degree of freedom: a shifted normal, squared; the draw of a row depends on its key alone."""
    normal = F.sqrt(-2 * F.log(uniform(seed, F.lit("a"), *key))) * F.cos(2 * math.pi * uniform(seed, F.lit("b"), *key))
    z = normal + F.sqrt(F.greatest(F.col(nonc), F.lit(0.0)))
    return z * z


def normalized_mass(b: np.ndarray, columns: list[int]) -> np.ndarray:
    m = np.asarray(b, dtype=float)[:, columns].sum(axis=0)
    return m / m.sum() if m.sum() > 0 else np.zeros_like(m)


def recovery(b: np.ndarray, truth: np.ndarray, columns: list[int]) -> dict[str, float | bool]:
    """How well the context shares of a fit match the true ones: the top two, the gap behind them, and the L1 error."""
    got = normalized_mass(b, columns)
    want = np.asarray(truth, dtype=float)
    want = want / want.sum() if want.sum() > 0 else want
    order, top = np.argsort(-got, kind="stable"), set(np.argsort(-want, kind="stable")[:2].tolist())
    gap = float(got[order[1]] - got[order[2]]) if len(got) > 2 else float("nan")
    return {"top_two_exact": set(order[:2].tolist()) == top, "gap": gap, "l1_error": float(np.abs(got - want).sum()), "causal_mass": float(got[list(top)].sum())}
