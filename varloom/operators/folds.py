"""Cross-validation folds of whole components, and the rows that may be scored."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Most components that the sequential assignment takes.
MOST = 2_000_000


def greedy_folds(components: list[tuple[int, int, list[int]]], n_folds: int) -> dict[int, int]:
    """Fold of each ``(component, size, genes)``.

    Largest first (then most genes, then lowest identifier). A component goes to the fold in which
    fewest of its genes have been seen; among those, to the one with fewest rows, then the first.
    """
    if n_folds < 2:
        raise ValueError("n_folds must be at least two")
    rows = [0] * n_folds
    seen: dict[int, set[int]] = defaultdict(set)
    out = {}
    for comp, size, genes in sorted(components, key=lambda c: (-c[1], -len(c[2]), c[0])):
        met = [0] * n_folds
        for g in genes:
            for f in seen[g]:
                met[f] += 1
        fold = min(range(n_folds), key=lambda f: (met[f], rows[f], f))
        out[comp] = fold
        rows[fold] += size
        for g in genes:
            seen[g].add(fold)
    return out


def assign_folds(members: DataFrame, links: DataFrame, n_folds: int, most: int = MOST) -> DataFrame:
    """``component, fold``. ``members`` is ``variant_idx, component``, ``links`` is ``variant_idx, gene_idx``.

    The assignment is sequential by definition: one task takes one row per component, with a checked
    bound on their number (a genome has some thousands to some hundred thousands).
    """
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    if sizes.count() > most:
        raise ValueError(f"more than {most} components: the sequential assignment is meant for fewer")
    genes = members.join(links, "variant_idx").groupBy("component").agg(F.collect_set("gene_idx").alias("genes"))
    rows = sizes.join(genes, "component", "left").select("component", "size", F.coalesce("genes", F.array().cast("array<bigint>")).alias("genes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(int(c), int(n), list(g)) for b in batches for c, n, g in zip(b["component"], b["size"], b["genes"])]
        folds = greedy_folds(held, n_folds)
        yield pd.DataFrame({"component": list(folds), "fold": list(folds.values())})

    return rows.coalesce(1).mapInPandas(run, "component long, fold int")


def score_rows(folds: DataFrame, links: DataFrame) -> DataFrame:
    """``variant_idx, fold, score_group``: -1 unless one of the variant's genes is also in another fold.

    ``folds`` is ``variant_idx, fold``, ``links`` is ``variant_idx, gene_idx``.
    """
    lf = links.select("variant_idx", "gene_idx").distinct().join(folds, "variant_idx")
    shared = lf.groupBy("gene_idx").agg(F.min("fold").alias("lo"), F.max("fold").alias("hi")).where("lo < hi").select("gene_idx")
    ok = lf.join(shared, "gene_idx", "left_semi").select("variant_idx").distinct().withColumn("_ok", F.lit(True))
    return folds.join(ok, "variant_idx", "left").select("variant_idx", "fold", F.when(F.col("_ok"), F.col("fold")).otherwise(-1).alias("score_group"))
