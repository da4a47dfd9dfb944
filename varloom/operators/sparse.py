"""Sparse matrices as long tables: products are an equi-join on the shared index and a sum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Rows of a matrix that are multiplied in one task, by their index, and products that are made at once.
SPAN, PRODUCTS = 4_096, 2_000_000


def clean_triples(df: DataFrame) -> DataFrame:
    """``variant_idx, gene_idx, mechanism_idx, value``: the largest finite value >= 0 of each key; rows without a gene are left out."""
    v = F.col("value")
    ok = (F.col("variant_idx") >= 0) & (F.col("gene_idx") >= 0) & (v >= 0) & (v < float("inf"))
    return df.where(ok & ~F.isnan(v)).groupBy("variant_idx", "gene_idx", "mechanism_idx").agg(F.max("value").alias("value"))


def ld_pairs(df: DataFrame, cut: float = 0.01) -> DataFrame:
    """``chrom, region, a, b, r2`` with a < b: the largest valid value of each pair in either direction that reaches the cut."""
    ok = (F.col("r2") >= cut) & (F.col("r2") <= 1.0) & (F.col("row_idx") != F.col("col_idx"))
    a, b = F.least("row_idx", "col_idx"), F.greatest("row_idx", "col_idx")
    return df.where(ok).groupBy("chrom", "region", a.alias("a"), b.alias("b")).agg(F.max("r2").alias("r2"))


def symmetric(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """``row_idx, col_idx, r2``: both directions of every pair (a < b) and a unit diagonal for all of ``ids`` (one column, distinct)."""
    one = F.struct(F.col("a").alias("row_idx"), F.col("b").alias("col_idx"))
    two = F.struct(F.col("b").alias("row_idx"), F.col("a").alias("col_idx"))
    both = pairs.select(F.explode(F.array(one, two)).alias("e"), "r2").select("e.row_idx", "e.col_idx", "r2")
    i = F.col(ids.columns[0])
    return both.unionByName(ids.select(i.alias("row_idx"), i.alias("col_idx"), F.lit(1.0).alias("r2")))


def squared(df: DataFrame, r: str, cut: float, n: int | None = None) -> DataFrame:
    """Correlations to squared ones, cut before and after the sample-size adjustment."""
    from ..functions.scalars import unbiased_r2

    out = df.withColumn("r2", F.col(r) * F.col(r)).where(F.col("r2") >= cut)
    return out if n is None else out.withColumn("r2", unbiased_r2("r2", n)).where(F.col("r2") >= cut)


def spmv(matrix: DataFrame, vector: DataFrame, value: str | Column = "value", extra: list[str] | None = None, out: str = "value") -> DataFrame:
    """``row_idx, extra..., out``: the matrix times a vector ``variant_idx[, extra...], value``; one join and one sum.

    ``extra`` are further columns of the vector (one vector for each of their values).
    """
    extra = extra or []
    v = vector.select(F.col(vector.columns[0]).alias("col_idx"), *extra, (F.col(value) if isinstance(value, str) else value).alias("_v"))
    return matrix.join(v, "col_idx").groupBy("row_idx", *extra).agg(F.sum(F.col("r2") * F.col("_v")).alias(out))


def row_lists(matrix: DataFrame, vectors: DataFrame, rows: DataFrame, scale: float, last: int, contexts: int = 0) -> DataFrame:
    """``rows`` (``row, fold, chrom, region, y, w``, whole numbers and doubles) with the arrays ``ps, xs`` of their products with sparse ``vectors`` (``variant_idx, p, value``).

    Parameter ``last`` is the row's sum; with ``contexts`` the values are also summed by ``p % contexts``, as the parameters before ``last``.
    Rows of neighbouring indices share a task, which gets each vector's entries once, so the products are not shuffled,
    however many there are. Any index may meet any other.
    """
    part = lambda c: F.floor(F.col(c) / SPAN)
    m = matrix.where(F.col("row_idx").isNotNull() & F.col("col_idx").isNotNull())
    none = lambda kind: F.lit(None).cast(f"array<{kind}>")
    v = vectors.where(F.col("variant_idx").isNotNull()).groupBy(F.col("variant_idx").alias("a")).agg(F.collect_list(F.struct("p", "value")).alias("_v"))
    to = m.where(part("row_idx") != part("col_idx")).groupBy(F.col("col_idx").alias("a")).agg(F.collect_set(part("row_idx")).alias("_to"))  # besides their own part's task
    lists = v.join(to, "a", "left").select(F.explode(F.concat(F.array(part("a")), F.coalesce("_to", F.array().cast("array<bigint>")))).alias("part"), F.lit(0).alias("kind"), "a", F.lit(0).cast("long").alias("b"), F.lit(0.0).alias("v"), F.col("_v.p").alias("ps"), F.col("_v.value").alias("vs"))
    long = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-1).cast("long"))
    own = rows.where(F.col("row").isNotNull()).select(part("row"), F.lit(1), "row", F.col("fold").cast("long"), F.lit(0.0), F.array(long("chrom"), long("region")), F.array(F.col("y").cast("double"), F.col("w").cast("double")))
    pairs = m.select(part("row_idx"), F.lit(2), "row_idx", "col_idx", "r2", none("bigint"), none("double"))
    both = lists.union(own).union(pairs).repartition("part").sortWithinPartitions("part", "kind", "a")
    both = both.withColumns({c: F.coalesce(c, F.array().cast(f"array<{kind}>")) for c, kind in (("ps", "bigint"), ("vs", "double"))})  # the size of a batch is asked for at every row, which walks over all nulls at its end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, lists_, rows_ = None, [], None, None

        def arrays(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
            c = b.column(k)
            return np.diff(c.offsets.to_numpy()), c.flatten().to_numpy(zero_copy_only=False)

        def joined(parts: list) -> tuple:
            return tuple(np.concatenate(x) for x in zip(*parts))

        def products(pieces: list) -> Iterator[pa.RecordBatch]:
            a, b, r = joined(pieces)
            col, size, ps, vs = lists_
            if rows_ is None:
                return
            on = np.isin(a, rows_[0])
            a, b, r = a[on], b[on], r[on]
            if not len(a):
                return
            row, own_ = np.unique(a, return_inverse=True)
            k = np.minimum(np.searchsorted(col, b), max(len(col) - 1, 0))
            hit = np.flatnonzero(col[k] == b) if len(col) else np.zeros(0, dtype=np.int64)
            k, n = k[hit], size[k[hit]]
            first = np.cumsum(size) - size
            take = np.arange(int(n.sum())) + np.repeat(first[k] - (np.cumsum(n) - n), n)
            p, x, o = ps[take], vs[take] * np.repeat(r[hit], n), np.repeat(own_[hit], n)
            if contexts:
                p, x, o = np.append(p, last - contexts + p % contexts), np.append(x, x), np.append(o, o)
            p, x, o = np.append(p, np.full(len(a), last)), np.append(x, r), np.append(o, own_)
            key = o * (last + 1) + p
            order = np.argsort(key, kind="stable")
            key, x = key[order], x[order]
            edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, x = key[edge], scale * np.add.reduceat(x, edge)
            offsets = np.append(np.searchsorted(key // (last + 1), np.arange(len(row))), len(key)).astype(np.int32)
            i = np.searchsorted(rows_[0], row)
            out = [pa.array(row), *[pa.array(np.ascontiguousarray(c[i])) for c in rows_[1:]]]
            yield pa.RecordBatch.from_arrays([*out, pa.ListArray.from_arrays(offsets, pa.array(key % (last + 1))), pa.ListArray.from_arrays(offsets, pa.array(x))], names=["row", "fold", "chrom", "region", "y", "w", "ps", "xs"])

        def blocks(final: bool) -> Iterator[pa.RecordBatch]:
            """Products of whole rows, as many as are made at once."""
            if not held:
                return
            a, b, r = joined(held)
            end = len(a) if final else int(np.searchsorted(a, a[-1]))
            k = np.minimum(np.searchsorted(lists_[0], b[:end]), max(len(lists_[0]) - 1, 0))
            made = np.cumsum(1 + (lists_[1][k] if len(lists_[0]) else 0) * np.ones(end, dtype=np.int64))
            lo = 0
            while lo < end:
                hi = int(np.searchsorted(made, (made[lo - 1] if lo else 0) + PRODUCTS)) + 1
                hi = min(end, int(np.searchsorted(a[:end], a[min(hi, end) - 1], side="right")))
                yield from products([(a[lo:hi], b[lo:hi], r[lo:hi])])
                lo = hi
            held[:] = [(a[end:], b[end:], r[end:])] if end < len(a) else []

        found: list = [[], []]
        for batch in batches:
            parts = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in _stretches(parts):
                if parts[lo] != at:
                    yield from blocks(True)
                    at, found, lists_, rows_ = parts[lo], [[], []], None, None
                piece = batch.slice(lo, hi - lo)
                kinds, a = piece.column(1).to_numpy(), piece.column(2).to_numpy()
                x, y = (int(np.searchsorted(kinds, k)) for k in (1, 2))
                if x:
                    q = piece.slice(0, x)
                    n, p = arrays(q, 5)
                    found[0].append((a[:x], n, p, arrays(q, 6)[1]))
                if y > x:
                    q = piece.slice(x, y - x)
                    g, w = arrays(q, 5)[1].reshape(-1, 2), arrays(q, 6)[1].reshape(-1, 2)
                    found[1].append((a[x:y], q.column(3).to_numpy(), g[:, 0], g[:, 1], w[:, 0], w[:, 1]))
                if y < len(a):
                    if lists_ is None:
                        none_ = np.zeros(0, dtype=np.int64)
                        lists_, rows_ = joined(found[0]) if found[0] else (none_, none_, none_, np.zeros(0)), joined(found[1]) if found[1] else None
                    held.append((a[y:], piece.column(3).to_numpy()[y:], piece.column(4).to_numpy()[y:]))
                    if sum(len(h[0]) for h in held) >= PRODUCTS // 8:
                        yield from blocks(False)
        yield from blocks(True)

    return both.mapInArrow(run, "row long, fold long, chrom long, region long, y double, w double, ps array<long>, xs array<double>")


def _stretches(x: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of equal values."""
    edge = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
    return [(a, b) for a, b in zip(edge, edge[1:]) if b > a]


def ld_score(matrix: DataFrame) -> DataFrame:
    """``row_idx, ld_score``: row sums."""
    return matrix.groupBy("row_idx").agg(F.sum("r2").alias("ld_score"))


def context_scores(triples: DataFrame, mode: str = "sum", excluded: list[int] | None = None) -> DataFrame:
    """``variant_idx, mechanism_idx, value``: sum over genes, or 1 where it is positive (``binary``)."""
    if mode not in ("sum", "binary"):
        raise ValueError("mode must be 'sum' or 'binary'")
    t = triples.where(~F.col("mechanism_idx").isin(excluded)) if excluded else triples
    s = t.groupBy("variant_idx", "mechanism_idx").agg(F.sum("value").alias("value"))
    return s if mode == "sum" else s.withColumn("value", (F.col("value") > 0).cast("double"))


def param_index(gene: str | Column, mechanism: str | Column, n_mechanisms: int) -> Column:
    g = F.col(gene) if isinstance(gene, str) else gene
    m = F.col(mechanism) if isinstance(mechanism, str) else mechanism
    return g * F.lit(n_mechanisms) + m


def mediated(triples: DataFrame, coefficients: DataFrame) -> DataFrame:
    """``variant_idx, value``: each variant's annotations weighted by ``gene_idx, mechanism_idx, coef``."""
    j = triples.join(coefficients, ["gene_idx", "mechanism_idx"])
    return j.groupBy("variant_idx").agg(F.sum(F.col("value") * F.col("coef")).alias("value"))


def mass(triples: DataFrame) -> DataFrame:
    """``gene_idx, mechanism_idx, mass``: column sums."""
    return triples.groupBy("gene_idx", "mechanism_idx").agg(F.sum("value").alias("mass"))


def context_contributions(masses: DataFrame, coefficients: DataFrame, context_mass: DataFrame, effects: DataFrame) -> DataFrame:
    """Global and deviation contribution of each context, their total, and its share (0 where the sum is not positive).

    ``context_mass`` is ``mechanism_idx, annotation_count``, ``effects`` is ``mechanism_idx, effect``.
    """
    dev = masses.join(coefficients, ["gene_idx", "mechanism_idx"]).groupBy("mechanism_idx").agg(F.sum(F.col("mass") * F.col("coef")).alias("deviation_h2"))
    x = context_mass.join(effects, "mechanism_idx").join(dev, "mechanism_idx", "left")
    x = x.withColumn("global_h2", F.col("annotation_count") * F.col("effect")).withColumn("deviation_h2", F.coalesce("deviation_h2", F.lit(0.0)))
    x = x.withColumn("total_h2", F.col("global_h2") + F.col("deviation_h2"))
    whole = x.agg(F.sum("total_h2").alias("_w"))  # one row
    share = F.when(F.col("_w") > 0, F.col("total_h2") / F.col("_w")).otherwise(0.0)
    y = x.withColumn("_one", F.lit(1)).join(F.broadcast(whole.withColumn("_one", F.lit(1))), "_one")
    return y.select("mechanism_idx", "annotation_count", "global_h2", "deviation_h2", "total_h2", share.alias("fraction"))


def normal_equations(design: DataFrame, columns: list[str], y: str, w: str, by: list[str] | None = None, more: list[Column] | None = None) -> DataFrame:
    """``by..., i, j, value`` of the weighted normal equations, from one pass over a wide design.

    ``j = len(columns)`` is the right-hand side; the last rows hold y'Wy at (len, len) and the sum
    of weights at (len, len + 1). ``more`` are further aggregates, repeated in every row. All sums are combined on the map side; the result has a few rows.
    """
    by, more, n = by or [], more or [], len(columns)
    cells = [(i, j, F.sum(F.col(w) * F.col(columns[i]) * F.col(columns[j]))) for i in range(n) for j in range(i, n)]
    cells += [(i, n, F.sum(F.col(w) * F.col(columns[i]) * F.col(y))) for i in range(n)]
    cells += [(n, n, F.sum(F.col(w) * F.col(y) * F.col(y))), (n, n + 1, F.sum(F.col(w)))]
    wide = design.groupBy(*by).agg(*[c.alias(f"c{i}_{j}") for i, j, c in cells], *more)
    rest = [c for c in wide.columns if c not in by and c not in {f"c{i}_{j}" for i, j, _ in cells}]
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("value")) for i, j, _ in cells])
    return wide.select(*by, *rest, F.explode(rows).alias("r")).select(*by, "r.i", "r.j", "r.value", *rest)
