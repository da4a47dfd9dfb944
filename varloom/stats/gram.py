"""Sufficient statistics of the weighted quadratic loss, from one distributed pass.

With fixed weights the loss is quadratic in all coefficients, so the Gram matrix of the design, its
product with the response, the response's square and the number of rows replace the rows in every
iteration, every penalty and every fold: a fold is trained on the whole minus its own part. Parameters
meet only where their variants share a region, so a model of a hundred thousand parameters has a
sparse Gram, of which the driver keeps the entries that exist, up to a bound that is checked first.

A row of ``m`` non-zeros has ``m (m + 1) / 2`` of the Gram's entries, so the products with the Gram that a fit
needs are also made from the rows themselves (``Rows``), whose number of non-zeros has no bound.
"""

from __future__ import annotations

import atexit
import itertools
import os
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import Scratch

#: Most parameters of a model, and most pairs of them that meet, of a Gram on the driver (16 bytes a pair, twice that while it is read).
MOST_PARAMS, MOST_ENTRIES = 1_000_000, 60_000_000
#: A model of this many parameters has a dense Gram.
DENSE = 1_000
#: Rows and cells of the design that a task multiplies at once, and columns of one product.
ROWS, CELLS, TILE = 4_096, 4_000_000, 1_024
#: Products of non-zeros that are made at once, and the part of a group's dense products from which on the dense ones are cheaper.
PAIRS, THIN = 50_000, 1 / 100
#: Values that are rounded at once, few enough for a processor's cache.
PIECE = 16_000
#: Non-zeros of a design's rows that are multiplied at once, and that a process holds in memory; more are mapped from files.
CHUNK, IN_MEMORY = 1_000_000, 2_000_000


@dataclass
class Quadratic:
    """A loss ``(x'gx - 2h'x + q) / n``; subclasses give the product with ``g``. ``n`` is the number of rows with a weight."""

    h: np.ndarray
    q: float
    n: int
    blocks: list["Quadratic"] = field(default_factory=list)

    @property
    def size(self) -> int:
        return len(self.h)

    def dot(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def square(self, x: np.ndarray) -> float:
        """``x'gx``."""
        return float(x @ self.dot(x))

    def columns(self, which: Iterable[int]) -> np.ndarray:
        unit = lambda j: np.bincount([j], minlength=self.size).astype(float)
        return np.stack([self.dot(unit(j)) for j in which], axis=1)

    def loss(self, beta: np.ndarray) -> float:
        return float((beta @ self.dot(beta) - 2 * self.h @ beta + self.q) / max(self.n, 1))

    def gradient(self, beta: np.ndarray) -> np.ndarray:
        return 2 * (self.dot(beta) - self.h) / max(self.n, 1)

    def __sub__(self, other: "Quadratic") -> "Quadratic":
        return Difference(self, other)


class Gram(Quadratic):
    """A dense one."""

    def __init__(self, g: np.ndarray, h: np.ndarray, q: float, n: int, blocks: list[Quadratic] | None = None):
        super().__init__(h, q, n, blocks or [])
        self.g = g

    def dot(self, x: np.ndarray) -> np.ndarray:
        return self.g @ x

    def columns(self, which: Iterable[int]) -> np.ndarray:
        return self.g[:, list(which)]


class SparseGram(Quadratic):
    """The pairs ``i <= j`` that meet, with their values."""

    def __init__(self, i: np.ndarray, j: np.ndarray, v: np.ndarray, h: np.ndarray, q: float, n: int, blocks: list[Quadratic] | None = None):
        super().__init__(h, q, n, blocks or [])
        order = np.lexsort((j, i))
        i, self.j, self.v = i[order], j[order].astype(np.intp), v[order]
        self.rows, self.starts = np.unique(i, return_index=True)
        self.counts = np.diff(np.append(self.starts, len(i)))
        on = i == self.j
        self.diagonal = np.bincount(self.j[on], self.v[on], minlength=self.size)

    def dot(self, x: np.ndarray) -> np.ndarray:
        out = np.bincount(self.j, self.v * np.repeat(x[self.rows], self.counts), minlength=self.size) - self.diagonal * x
        if len(self.rows):
            out[self.rows] += np.add.reduceat(self.v * x[self.j], self.starts)
        return out


class Difference(Quadratic):
    """One loss's rows without another's."""

    def __init__(self, whole: Quadratic, part: Quadratic):
        pairs = zip(whole.blocks, part.blocks) if len(whole.blocks) == len(part.blocks) else ()
        super().__init__(whole.h - part.h, whole.q - part.q, whole.n - part.n, [a - b for a, b in pairs])
        self.whole, self.part = whole, part

    def dot(self, x: np.ndarray) -> np.ndarray:
        return self.whole.dot(x) - self.part.dot(x)

    def columns(self, which: Iterable[int]) -> np.ndarray:
        which = list(which)
        return self.whole.columns(which) - self.part.columns(which)


class Sum(Quadratic):
    """The rows of several losses, which stay its blocks."""

    def __init__(self, parts: list[Quadratic]):
        super().__init__(sum(p.h for p in parts), sum(p.q for p in parts), sum(p.n for p in parts), list(parts))

    def dot(self, x: np.ndarray) -> np.ndarray:
        return sum(p.dot(x) for p in self.blocks)

    def columns(self, which: Iterable[int]) -> np.ndarray:
        which = list(which)
        return sum(p.columns(which) for p in self.blocks)


@dataclass
class Chunk:
    """Rows of a design that have non-zeros; ``p`` becomes places in ``cols``, the parameters that occur."""

    counts: np.ndarray
    p: np.ndarray
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    fold: np.ndarray

    def __post_init__(self) -> None:
        self.starts = np.cumsum(self.counts, dtype=np.int64) - self.counts
        self.cols, p = np.unique(self.p, return_inverse=True)
        self.p = p.astype(np.int32)

    def mapped(self, folder: str) -> "Chunk":
        """The same with the long arrays in files."""
        for name in ("p", "x"):
            a = getattr(self, name)
            path = os.path.join(folder, f"{len(os.listdir(folder))}.bin")
            a.tofile(path)
            setattr(self, name, np.memmap(path, dtype=a.dtype, mode="r"))
        return self

    def times(self, z: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.x * z[self.cols][self.p], self.starts)

    def back(self, u: np.ndarray, out: np.ndarray) -> None:
        out[self.cols] += np.bincount(self.p, self.x * np.repeat(u, self.counts), minlength=len(self.cols))

    def end(self, first: int, width: int) -> np.ndarray:
        """The last parameters' columns, dense."""
        on = np.flatnonzero(self.p >= np.searchsorted(self.cols, first))
        out = np.zeros((len(self.counts), width))
        np.add.at(out, (np.searchsorted(self.starts, on, side="right") - 1, self.cols[self.p[on]] - first), self.x[on])
        return out


class Rows(Quadratic):
    """The loss over rows of a design: a product with its Gram is one with the rows and one back. ``weights`` may replace the chunks' own."""

    def __init__(self, chunks: list[Chunk], size: int, weights: list[np.ndarray] | None = None, blocks: list["Quadratic"] | None = None):
        self.chunks, self.params, self.blocks = chunks, size, blocks or []
        self.weights = [c.w for c in chunks] if weights is None else weights
        self.n = sum(int(np.count_nonzero(w)) for w in self.weights)
        self.q = float(sum(w @ (c.y * c.y) for c, w in zip(chunks, self.weights)))

    @property
    def size(self) -> int:
        return self.params

    @cached_property
    def h(self) -> np.ndarray:
        return self._back(lambda c: c.y)

    def _back(self, of) -> np.ndarray:
        out = np.zeros(self.params)
        for c, w in zip(self.chunks, self.weights):
            c.back(w * of(c), out)
        return out

    def dot(self, x: np.ndarray) -> np.ndarray:
        return self._back(lambda c: c.times(x))

    def square(self, x: np.ndarray) -> float:
        return float(sum(w @ c.times(x) ** 2 for c, w in zip(self.chunks, self.weights)))

    def loss(self, beta: np.ndarray) -> float:
        return float(sum(w @ (c.y - c.times(beta)) ** 2 for c, w in zip(self.chunks, self.weights)) / max(self.n, 1))

    def end_equations(self, b: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The equations of the last ``end`` parameters beside coefficients ``b``, without a vector of all parameters."""
        z, normal, rhs = np.append(b.ravel(), np.zeros(end)), np.zeros((end, end)), np.zeros(end)
        for c, w in zip(self.chunks, self.weights):
            e = c.end(self.params - end, end)
            normal += e.T @ (w[:, None] * e)
            rhs += e.T @ (w * (c.y - c.times(z)))
        return normal, rhs

    def fold(self, fold: int) -> tuple["Rows", "Rows"]:
        """What trains a fold (the rows of the others), and its own rows without weights; nothing is copied."""
        own = [c.fold == fold for c in self.chunks]
        train = [np.where(o, 0.0, w) for o, w in zip(own, self.weights)]
        return Rows(self.chunks, self.params, train), Rows(self.chunks, self.params, [o.astype(float) for o in own])


def total(parts: list[Quadratic]) -> Quadratic:
    return Sum(parts)


def _products(m: np.ndarray, w: np.ndarray, names: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The non-zero entries of ``m'diag(w)m``, each pair once, tile by tile."""
    for a in range(0, m.shape[1], TILE):
        left = (m[:, a : a + TILE] * w[:, None]).T
        for b in range(a, m.shape[1], TILE):
            g = left @ m[:, b : b + TILE]
            i, j = np.nonzero(np.triu(g) if a == b else g)
            x, y = names[a + i], names[b + j]
            yield np.minimum(x, y), np.maximum(x, y), g[i, j]


def gram_entries(design: DataFrame, by: list[str], near: list[str] | str = "region", unweighted: bool = False) -> DataFrame:
    """``by..., s, p, q, value`` with p <= q, for ``design`` of ``by..., near..., row, p, x, y, w`` (one row per non-zero).

    ``s`` is 0 for the weighted products and 1 for those without weights, which are made in the same
    pass if asked for. Parameter -1 stands for the response and -2 for a row's presence: (-1, -1) holds
    y'Wy, (-2, -2) the number of rows. Rows come together by ``near`` (parameters meet within a
    region), each task multiplies blocks of bounded size, and partial sums are combined.
    """
    near = [near] if isinstance(near, str) else near
    keys = list(dict.fromkeys([*by, *near]))
    rows = design if "ps" in design.columns else design.groupBy(*keys, "row").agg(F.collect_list("p").alias("ps"), F.collect_list("x").alias("xs"), F.first("y").alias("y"), F.first("w").alias("w"))
    rows = rows.where("w != 0").repartition(*keys).sortWithinPartitions(*keys)
    rows = rows.select(*by, "ps", "xs", F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in by]
    types = [pa.int32() if rows.schema[b].dataType.simpleString() == "int" else pa.int64() for b in by]
    names = [*by, "s", "p", "q", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            ps, xs = b.column(len(by)), b.column(len(by) + 1)
            start = np.append(ps.offsets.to_numpy(), [])[: n + 1].astype(np.int64)
            p, x = ps.values.to_numpy(zero_copy_only=False), xs.values.to_numpy(zero_copy_only=False)
            y, w = (b.column(len(by) + k).to_numpy(zero_copy_only=False) for k in (2, 3))
            key = [b.column(k).to_numpy(zero_copy_only=False) for k in range(len(by))]
            new = np.ones(n, dtype=bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in key], axis=0) if key else False
            edges = [*np.flatnonzero(new).tolist(), n]
            for lo, hi in zip(edges, edges[1:]):
                at = lo
                while at < hi:
                    end = min(hi, at + ROWS)
                    while True:
                        part = slice(start[at], start[end])
                        params, where = np.unique(p[part], return_inverse=True)
                        if end - at == 1 or (end - at) * len(params) <= CELLS:
                            break
                        end = at + max(1, (end - at) // 2)
                    m = np.zeros((end - at, len(params) + 1))
                    np.add.at(m, (np.repeat(np.arange(end - at), np.diff(start[at : end + 1])), where), x[part])
                    m[:, -1] = y[at:end]
                    called = np.append(params, -1)
                    for s in (0, 1) if unweighted else (0,):
                        one = (np.array([-2]), np.array([-2]), np.array([float(end - at)]))
                        for i, j, v in itertools.chain(_products(m, w[at:end] if s == 0 else np.ones(end - at), called), [one]):  # a tile at a time is held
                            ks = [pa.array(np.full(len(i), c[at]), t) for c, t in zip(key, types)]
                            yield pa.RecordBatch.from_arrays([*ks, pa.array(np.full(len(i), s), pa.int32()), pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(v)], names=names)
                    at = end

    out = rows.mapInArrow(run, ", ".join([*kinds, "s int", "p long", "q long", "value double"]))
    return out.groupBy(*by, "s", "p", "q").agg(F.sum("value").alias("value"))


def _rounded(v: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, without a negative zero."""
    out, scale = np.empty(len(v)), 10.0**digits
    for at in range(0, len(v), PIECE):
        x = v[at : at + PIECE]
        with np.errstate(over="ignore", invalid="ignore"):  # infinite beyond the largest double: there the value stays
            a = x * scale
            r = np.rint(a)
            tie = np.abs(a - r) == 0.5  # goes to the even one there
        if tie.any():
            r[tie] = a[tie] + np.copysign(0.5, a[tie])
        r /= scale
        r += 0.0
        out[at : at + PIECE] = r if np.isfinite(a).all() else np.where(np.isinf(a), x, r)
    return out


def _thin_products(row: np.ndarray, p: np.ndarray, x: np.ndarray, w: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The non-zero entries ``i, j, value`` of the weighted products of non-zeros (sorted by ``row, p``, each once), a stretch of parameters ``i`` at a time; nothing is made for those that never meet."""
    many = np.searchsorted(row, row, side="right") - np.arange(len(row))  # from itself to its row's end
    by_p = np.argsort(p, kind="stable")
    first = np.searchsorted(p[by_p], np.arange(size + 1))
    made = np.append(0, np.cumsum(many[by_p]))
    lo = 0
    while lo < size:
        hi = max(lo + 1, int(np.searchsorted(made[first], made[first[lo]] + PAIRS, side="right")) - 1)
        width, at, parts = size - lo, first[lo], []
        while at < first[hi]:
            end = min(first[hi], max(at + 1, int(np.searchsorted(made, made[at] + PAIRS, side="right")) - 1))
            e = by_p[at:end]
            n = many[e]
            to = np.arange(made[end] - made[at]) + np.repeat(e - (made[at:end] - made[at]), n)
            key, v = p[to], x[to]
            key += np.repeat((p[e] - lo) * width - lo, n)
            v *= np.repeat(x[e] * w[row[e]], n)
            parts.append(_sums(key, v, (hi - lo) * width))
            if len(parts) > 1:  # of one parameter only
                parts = [_sums(*(np.concatenate(c) for c in zip(*parts)), width)]
            at = end
        for k, g in parts:
            if not g.all():
                k, g = k[g != 0], g[g != 0]
            i = k // width
            k -= i * width
            i += lo
            k += lo
            yield i, k, g
        lo = hi


def _sums(key: np.ndarray, v: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys that occur, sorted, with the sums of their values."""
    if cells <= 16 * len(key):
        g = np.bincount(key, v, cells)
        k = np.flatnonzero(g != 0)
        return k, g[k]
    order = np.argsort(key, kind="stable")
    key = key[order]
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[edge], np.add.reduceat(v[order], edge)


def whole_gram(rows: DataFrame, near: list[str], digits: int | None = None) -> DataFrame:
    """``p, q, value`` (rounded to ``digits``) of all ``rows`` (``near..., row, ps, xs, y, w``, staged once), as ``gram_entries`` has them, without a shuffle of pairs that meet in one group ``near`` only.

    A task multiplies the non-zeros of a group, or, where most parameters meet, dense tiles over all its rows, so a pair comes once
    and only a stretch of them is held. A pair with a parameter that no other group has is whole as it is; the others, of
    parameters that several groups have, are summed.
    """
    x = Scratch(rows.sparkSession, "gram").stage(rows.where("w != 0").select(*near, "ps", "xs", "y", "w"), release=True)
    spread = x.select(*near, F.explode("ps").alias("p")).groupBy(*near, "p").agg(F.lit(1).alias("_")).groupBy("p").agg(F.collect_list(F.struct(*near)).alias("_n")).where(F.size("_n") > 1)
    shared = spread.select(F.explode("_n").alias("_n"), "p").groupBy(*[F.col(f"_n.{k}").alias(k) for k in near]).agg(F.collect_list("p").alias("ps"))
    none = F.lit(None).cast("array<double>")
    both = shared.select(*near, F.lit(0).alias("kind"), "ps", none.alias("xs"), F.lit(0.0).alias("y"), F.lit(0.0).alias("w")).union(x.select(*near, F.lit(1), "ps", "xs", "y", "w"))
    both = both.repartition(*near).sortWithinPartitions(*near, "kind")
    at = len(near)

    def entries(held: list[pa.RecordBatch], common: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        known = [b.column(at + 1).flatten().to_numpy() for b in held if b.column(at)[0].as_py() == 0]
        known = np.unique(np.concatenate([[-1], *known])).astype(np.int64)
        held = [b for b in held if b.column(at)[0].as_py() == 1]
        counts, p, x, y, w = (np.concatenate(c) for c in zip(*((np.diff(b.column(at + 1).offsets.to_numpy()), b.column(at + 1).flatten().to_numpy(), b.column(at + 2).flatten().to_numpy(), b.column(at + 3).to_numpy(), b.column(at + 4).to_numpy()) for b in held)))
        n = len(counts)
        row = np.append(np.repeat(np.arange(n), counts), np.arange(n))  # the response is parameter -1
        p, x = np.append(p, np.full(n, -1)), np.append(x, y)
        if common:
            on = np.isin(p, known)
            row, p, x = row[on], p[on], x[on]
            yield np.array([-2]), np.array([-2]), np.array([float(n)])
        names, p = np.unique(p, return_inverse=True)
        own = ~np.isin(names, known)
        key, where = np.unique(row * len(names) + p, return_inverse=True)
        x = np.bincount(where, x, len(key))
        row, p = key // len(names), key % len(names)
        each = np.bincount(row, minlength=n)
        if (each * (each + 1)).sum() < THIN * n * len(names) ** 2:
            for i, j, g in _thin_products(row, p, x, w, len(names)):
                if not common:
                    on = own[i] | own[j]
                    i, j, g = i[on], j[on], g[on]
                yield names[i], names[j], g
            return
        order = np.argsort(p, kind="stable")
        row, p, x = row[order], p[order], x[order]

        def dense(a: int, lo: int, hi: int) -> np.ndarray:
            i, j = np.searchsorted(p, [a, a + TILE])
            keep = slice(i, j) if hi - lo == n else np.arange(i, j)[(row[i:j] >= lo) & (row[i:j] < hi)]
            out = np.zeros((hi - lo, min(TILE, len(names) - a)))
            np.add.at(out, (row[keep] - lo, p[keep] - a), x[keep])
            return out

        for a in range(0, len(names), TILE):
            for b in range(a, len(names), TILE):
                g = 0.0
                for lo in range(0, n, ROWS):
                    hi = min(n, lo + ROWS)
                    left = dense(a, lo, hi)
                    g = g + (left * w[lo:hi, None]).T @ (left if a == b else dense(b, lo, hi))
                g = np.triu(g) if a == b else g
                i, j = np.nonzero(g if common else g * (own[a : a + TILE, None] | own[None, b : b + TILE]))
                yield names[a + i], names[b + j], g[i, j]

    def run(common: bool) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def made() -> Iterator[pa.RecordBatch]:
                if any(b.column(at)[b.num_rows - 1].as_py() == 1 for b in held):
                    for i, j, v in entries(held, common):
                        v = v if common or digits is None else _rounded(v, digits)
                        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(v)], names=["p", "q", "value"])

            held, last = [], None
            for b in batches:
                keys = np.stack([b.column(k).fill_null(-1).to_numpy().astype(np.int64) for k in [*range(at + 1)]], axis=1)
                edge = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
                for lo, hi in zip(edge, edge[1:]):
                    if hi > lo:
                        if last is not None and tuple(keys[lo, :at]) != last:
                            yield from made()
                            held = []
                        last = tuple(keys[lo, :at])
                        held.append(b.slice(lo, hi - lo))
            yield from made()

        return both.mapInArrow(each, "p long not null, q long not null, value double not null")  # nulls are not looked for in each of many rows

    whole = F.coalesce(F.sum("value"), F.lit(0.0))
    both_known = run(True).groupBy("p", "q").agg(whole.alias("value")).where("value <> 0")
    return run(False).union(both_known if digits is None else both_known.withColumn("value", F.coalesce(F.round("value", digits), "value")))


def load(entries: pd.DataFrame | pa.Table, n_params: int) -> Quadratic:
    """A Gram from its entries on the driver; refuses models above ``MOST_PARAMS``."""
    if n_params > MOST_PARAMS:
        raise ValueError(f"more than {MOST_PARAMS} parameters")
    p, q, v = (np.asarray(entries[c], dtype=t) for c, t in (("p", np.int64), ("q", np.int64), ("value", np.float64)))
    n, square = int(round(v[p == -2].sum())), float(v[(p == -1) & (q == -1)].sum())
    cross, pair = (p == -1) & (q >= 0), p >= 0
    h = np.bincount(q[cross], v[cross], minlength=n_params)
    i, j, v = p[pair], q[pair], v[pair]
    if n_params > DENSE:
        return SparseGram(i, j, v, h, square, n)
    g = np.zeros((n_params, n_params))
    np.add.at(g, (i, j), v)
    return Gram(g + np.triu(g, 1).T, h, square, n)


def bounded(entries: DataFrame, n_params: int) -> DataFrame:
    """``entries``, staged and counted: refused before anything is collected if there are too many."""
    if n_params > MOST_PARAMS:
        raise ValueError(f"more than {MOST_PARAMS} parameters")
    kept = Scratch(entries.sparkSession, "gram").stage(entries)
    n = kept.count()
    if n > MOST_ENTRIES:
        raise ValueError(f"{n} pairs of parameters meet, more than {MOST_ENTRIES}")
    return kept


def fetch(entries: DataFrame, n_params: int, by: str | None = None) -> Quadratic | dict[int, Quadratic]:
    """The weighted Gram of all rows, or one for each value of ``by``."""
    t = bounded(entries.where("s = 0"), n_params).toArrow()
    if by is None:
        return load(t, n_params)
    k = t[by].to_numpy()
    return {int(x): load(t.filter(pa.array(k == x)), n_params) for x in np.unique(k)}


def pack(design: DataFrame, block: str | None = None) -> DataFrame:
    """``block, data`` for a ``design`` of ``row, p, x, y, w`` (and ``fold``, ``block``) or, by rows, ``row, ps, xs, y, w``: the rows with a weight as packed arrays, staged."""
    fold, key = (F.coalesce(F.col(c).cast("long"), F.lit(-1).cast("long")) if c in design.columns else F.lit(0).cast("long") for c in ("fold", block or ""))
    rows = design.withColumns({"_block": key, "_fold": fold, "y": F.col("y").cast("double"), "w": F.col("w").cast("double")})
    if "ps" not in design.columns:
        rows = rows.groupBy("row").agg(*[F.first(c).alias(c) for c in ("_block", "_fold", "y", "w")], F.collect_list("p").alias("ps"), F.collect_list("x").alias("xs"))
    rows = rows.where("w != 0").select(F.col("_block").alias("block"), F.col("_fold").alias("fold"), "y", "w", "ps", "xs")
    rows = rows.sortWithinPartitions("block") if block else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at, fold, y, w = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            ps, xs = b.column(4), b.column(5)
            start = ps.offsets.to_numpy()
            p, x = ps.values.to_numpy(zero_copy_only=False), xs.values.to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            out = []
            for lo, hi in zip(edges, edges[1:]):
                part = slice(start[lo], start[hi])
                arrays = (np.diff(start[lo : hi + 1]).astype("<i4"), fold[lo:hi].astype("<i4"), y[lo:hi], w[lo:hi], x[part], p[part].astype("<i4"))
                out.append((int(at[lo]), hi - lo, b"".join(a.tobytes() for a in arrays)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())], names=["block", "n", "data"])

    return Scratch(design.sparkSession, "rows").stage(rows.mapInArrow(run, "block long, n long, data binary"))


def unstage(packed: DataFrame) -> None:
    Scratch(packed.sparkSession).drop(packed)


def unpack(pieces: list[tuple[int, bytes]]) -> Chunk:
    """One chunk of the rows of several packed pieces ``n, data``."""
    parts: list[list[np.ndarray]] = [[] for _ in range(6)]
    for n, data in pieces:
        counts, at = np.frombuffer(data, "<i4", n), 4 * n
        m = int(counts.sum())
        parts[0].append(counts)
        for k, (kind, length) in enumerate((("<i4", n), ("<f8", n), ("<f8", n), ("<f8", m), ("<i4", m)), 1):
            parts[k].append(np.frombuffer(data, kind, length, at))
            at += length * int(kind[2])
    counts, fold, y, w, x, p = (np.concatenate(a) for a in parts)
    return Chunk(counts, p, x, y, w, fold)


def chunks_of(pieces: Iterable[tuple[int, int, bytes]]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """The pieces ``block, n, data`` of a chunk with their block, one chunk after another: a chunk of each block is held at most."""
    held: dict[int, list[tuple[int, bytes]]] = {}
    for block, n, data in pieces:
        mine = held.setdefault(block, [])
        mine.append((n, bytes(data)))
        if sum(len(d) for _, d in mine) >= 12 * CHUNK:
            yield block, held.pop(block)
    yield from held.items()


class Holder:
    """Chunks in memory, or, beyond ``IN_MEMORY`` non-zeros, in files that go with the process."""

    def __init__(self) -> None:
        self.size, self.folder = 0, None

    def keep(self, c: Chunk) -> Chunk:
        self.size += len(c.x)
        if self.size <= IN_MEMORY:
            return c
        if self.folder is None:
            self.folder = tempfile.mkdtemp(prefix="varloom-rows-")
            atexit.register(shutil.rmtree, self.folder, True)
        return c.mapped(self.folder)


def rows_of(pieces: Iterable[tuple[int, int, bytes]], n_params: int, blocks: bool) -> Rows:
    """The loss over all rows of packed pieces, with its blocks."""
    holder, by = Holder(), {}
    for at, part in chunks_of(pieces):
        by.setdefault(at, []).append(holder.keep(unpack(part)))
    return Rows([c for _, cs in sorted(by.items()) for c in cs], n_params, blocks=[Rows(cs, n_params) for _, cs in sorted(by.items())] if blocks else [])


def in_task(design: DataFrame, n_params: int, then: Callable[[Rows], pa.Table], schema: str, block: str | None = None) -> DataFrame:
    """The table that ``then`` makes of the loss over all rows of the design, in one task that holds the rows as ``Rows``; nothing comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (tuple(b.column(k)[i].as_py() for k in range(3)) for b in batches for i in range(b.num_rows))
        yield from then(rows_of(pieces, n_params, block is not None)).to_batches(100_000)

    return pack(design, block).coalesce(1).mapInArrow(run, schema)
