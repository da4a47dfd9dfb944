"""Summaries of runs."""

from __future__ import annotations

import math

import pandas as pd


def summarize_run(cv_scores: dict[float, float], best_lambda: float, contributions: pd.DataFrame, expected: str, intercept: str = "intercept") -> dict:
    """Cross-validated gain over the largest penalty (contexts only) and the leading biological context.

    ``contributions`` has ``context, total_h2, fraction``; the first of tied contexts leads.
    """
    scores = {float(k): float(v) for k, v in cv_scores.items()}
    if not scores or not all(map(math.isfinite, scores.values())):
        raise ValueError("scores must be present and finite")
    if float(best_lambda) not in scores:
        raise ValueError("the best penalty has no score")
    if missing := {"context", "total_h2", "fraction"} - set(contributions.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    bio = contributions[contributions["context"] != intercept]
    if bio.empty:
        raise ValueError("no biological context")
    lead, whole = bio.loc[bio["total_h2"].astype(float).idxmax()], float(bio["total_h2"].sum())
    base, best = scores[max(scores)], scores[float(best_lambda)]
    return {
        "best_lambda": float(best_lambda), "best_score": best, "baseline_lambda": max(scores), "baseline_score": base,
        "improvement": base - best, "relative_improvement": (base - best) / base if base else math.nan,
        "leading_context": str(lead["context"]), "leading_fraction": float(lead["fraction"]),
        "leading_biological_fraction": float(lead["total_h2"]) / whole if whole > 0 else math.nan,
        "expected_leads": str(lead["context"]) == expected,
    }


def json_safe(x):
    """Plain JSON values: keys as strings, numpy scalars and arrays unwrapped, non-finite numbers as null."""
    if isinstance(x, dict):
        return {str(k): json_safe(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [json_safe(v) for v in x]
    if hasattr(x, "tolist"):
        return json_safe(x.tolist())
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x
