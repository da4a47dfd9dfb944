"""Weighted LD-score regression from normal equations, jackknife and context profiles."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import regression_weight
from ..operators.sparse import ld_score, normal_equations, spmv


@dataclass
class Regression:
    names: list[str]
    coefficients: list[float]
    implied_h2: list[float]
    weighted_mse: float
    condition_number: float
    n_variants: int

    def as_dict(self) -> dict:
        return asdict(self)


def design(matrix: DataFrame, scores: DataFrame, gwas: DataFrame, contexts: list[int], n: str | float = "n", totals: bool = False) -> DataFrame:
    """``variant_idx, x0.., y, w[, chrom]``: N times every context's LD score and, last, N times the residual LD score.

    With ``totals`` also ``_s0..``, the contexts' own scores.

    ``scores`` is ``variant_idx, mechanism_idx, value``; ``gwas`` has ``variant_idx, chisq`` and
    maybe ``chrom`` and ``n``. Variants without a finite chi-square or sample size are left out.
    """
    s = scores.where(F.col("mechanism_idx").isin(contexts))
    wide = spmv(matrix, s.select("variant_idx", "mechanism_idx", "value"), extra=["mechanism_idx"]).groupBy("row_idx").pivot("mechanism_idx", contexts).agg(F.sum("value"))
    size = F.col(n).cast("double") if isinstance(n, str) else F.lit(float(n))
    c = F.col("chisq")
    g = gwas.where(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) & size.isNotNull())
    x = g.join(ld_score(matrix).withColumnRenamed("row_idx", "variant_idx"), "variant_idx").join(wide.withColumnRenamed("row_idx", "variant_idx"), "variant_idx", "left")
    if totals:
        own = s.groupBy("variant_idx").agg(F.map_from_entries(F.collect_list(F.struct("mechanism_idx", "value"))).alias("_t"))  # one entry a context
        x = x.join(own, "variant_idx", "left")
    x = x.withColumns({f"_s{i}": F.coalesce(F.col("_t").getItem(k), F.lit(0.0)) for i, k in enumerate(contexts)}) if totals else x
    cols = [(size * F.coalesce(F.col(str(k)), F.lit(0.0))).alias(f"x{i}") for i, k in enumerate(contexts)] + [(size * F.col("ld_score")).alias(f"x{len(contexts)}")]
    keep = ["variant_idx"] + (["chrom"] if "chrom" in gwas.columns else [])
    if totals:
        keep += [f"_s{i}" for i in range(len(contexts))]
    return x.select(*keep, *cols, (c - 1).alias("y"), regression_weight(c).alias("w"))


def solve(cells: pd.DataFrame, names: list[str], totals: list[float], n_variants: int, chosen: list[int] | None = None) -> Regression:
    """Unconstrained weighted least squares from ``i, j, value`` cells; ``chosen`` selects contexts for a smaller model.

    Columns are scaled to unit length and a pseudo-inverse is used. ``totals`` are the sums of the
    contexts' scores, so that coefficient times total is a context's implied contribution.
    """
    p = len(names)
    if chosen is not None and (not chosen or min(chosen) < 0 or max(chosen) >= p - 1):
        raise ValueError("choose at least one context, by its index")
    g, h, yy, ww = np.zeros((p, p)), np.zeros(p), 0.0, 0.0
    for i, j, v in zip(cells["i"], cells["j"], cells["value"]):
        if i == p and j == p:
            yy = v
        elif i == p:
            ww = v
        elif j == p:
            h[i] = v
        else:
            g[i, j] = g[j, i] = v
    use = [*(range(p - 1) if chosen is None else chosen), p - 1]
    g, h = g[np.ix_(use, use)], h[use]
    d = np.sqrt(np.maximum(np.diag(g), np.finfo(float).tiny))
    scaled = g / d[:, None] / d[None, :]
    coef = np.linalg.pinv(scaled, rcond=1e-10) @ (h / d) / d
    sse = yy - 2 * coef @ h + coef @ g @ coef
    implied = [*(c * totals[k] for c, k in zip(coef[:-1], use[:-1])), coef[-1] * n_variants]
    return Regression([names[k] for k in use], coef.tolist(), [float(x) for x in implied], float(sse / max(ww, 1.0)), float(np.linalg.cond(scaled)), n_variants)


def fit(matrix: DataFrame, scores: DataFrame, gwas: DataFrame, contexts: list[int], names: list[str], n: str | float = "n") -> dict[str, Regression]:
    """A model of each context alone and one of all together, from a single Gram."""
    x = design(matrix, scores, gwas, contexts, n, totals=True)
    sums = [F.sum(f"_s{i}").alias(f"t{i}") for i in range(len(contexts))]
    # one evaluation of the design: cells, totals and the count come out of the same aggregate
    got = normal_equations(x, [f"x{i}" for i in range(len(contexts) + 1)], "y", "w", more=[*sums, F.count(F.lit(1)).alias("rows")]).toPandas()
    cells, totals, rows = got, [float(got[f"t{i}"].iloc[0] or 0.0) for i in range(len(contexts))], int(got["rows"].iloc[0])
    every = [*names, "residual_ld_score"]
    out = {nm: solve(cells, every, totals, rows, [i]) for i, nm in enumerate(names)}
    return out | {"joint": solve(cells, every, totals, rows)}


def context_profile(results: pd.DataFrame, contexts: list[str]) -> pd.DataFrame:
    """Non-negative context effects from a regression's result table (``name, coefficient[, standard_error]``)."""
    r = results[results["name"].isin(contexts)].copy()
    if missing := sorted(set(contexts) - set(r["name"])):
        raise ValueError(f"contexts without a result: {missing}")
    r["effect"] = r["coefficient"].clip(lower=0.0)
    keep = ["name", "effect"] + (["standard_error"] if "standard_error" in r else [])
    return r[keep].rename(columns={"name": "context"}).reset_index(drop=True)
