"""Small convex problems on gene-by-context sizes: quadratics over the orthant, proximal maps, alternation of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


def orthant_minimum(g: np.ndarray, r: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """The minimum of ``x'gx / 2 - r'x`` over ``x >= 0``, ``g`` symmetric and positive semidefinite.

    Works on the matrix itself: coordinates enter one at a time by the gain that a move along them
    alone would bring, the entered ones are solved together, and those that turn negative leave again.
    """
    n = len(r)
    d = np.diag(g)
    able = d > 0
    x, inside = np.zeros(n), np.zeros(n, dtype=bool)
    if not able.any():
        return x
    root = np.sqrt(np.where(able, d, 1.0))
    least = 1e-12 * float(np.max(np.abs(r[able]) / root[able], initial=0.0))
    for _ in range(rounds or 4 * n + 8):
        gain = np.where(able & ~inside, (r - g @ x) / root, -np.inf)
        j = int(np.argmax(gain))
        if not gain[j] > least:
            break
        inside[j] = True
        while inside.any():
            at = np.flatnonzero(inside)
            sub = g[np.ix_(at, at)] / np.outer(root[at], root[at])
            y = np.linalg.lstsq(sub, r[at] / root[at], rcond=1e-12)[0] / root[at]
            if (y > 0).all():
                x = np.zeros(n)
                x[at] = y
                break
            # as far towards the joint solution as no coordinate leaves the orthant; the one that stops the move leaves
            falls = y <= 0
            part = x[at][falls] / np.maximum(x[at][falls] - y[falls], np.finfo(float).tiny)
            t = float(part.min())
            x[at] += t * (y - x[at])
            out = at[falls][part <= t]
            x[out] = 0.0
            inside[out] = False
            if j in out and len(out) == 1 and t == 0.0:
                able = able & (np.arange(n) != j)  # it gained by rounding only
    return x


def nuclear(b: np.ndarray) -> float:
    """Sum of singular values, from the smaller of the two products of ``b`` with itself."""
    small = b.T @ b if b.shape[0] >= b.shape[1] else b @ b.T
    return float(np.sqrt(np.maximum(np.linalg.eigvalsh(small), 0.0)).sum())


def shrink_singular(b: np.ndarray, t: float, rank: int | None = None, seed: int = 0) -> np.ndarray:
    """The proximal map of ``t`` times the nuclear norm: singular values lowered by ``t``, not below zero.

    ``b (I - t (b'b)^(-1/2))+``, from the eigenvectors of the smaller product. With ``rank``, ``b`` is first
    projected on a subspace that holds its leading ``rank`` directions.
    """
    if rank is not None and rank < min(b.shape):
        basis = leading_subspace(b, rank, seed)
        return basis @ shrink_singular(basis.T @ b, t)
    if b.shape[0] < b.shape[1]:
        return shrink_singular(b.T, t).T
    value, v = np.linalg.eigh(b.T @ b)
    s = np.sqrt(np.clip(value, 0.0, None))
    keep = np.where(s > t, 1.0 - t / np.where(s > 0, s, 1.0), 0.0)
    return b @ ((v * keep) @ v.T)


def leading_subspace(b: np.ndarray, rank: int, seed: int = 0, sweeps: int = 4) -> np.ndarray:
    """An orthonormal basis, ``rank`` wide, of the leading left singular directions, by orthogonal iteration on random columns."""
    width = min(rank + 6, *b.shape)
    basis = np.linalg.qr(b @ np.random.default_rng(seed).normal(size=(b.shape[1], width)))[0]
    for _ in range(sweeps):
        basis = np.linalg.qr(b @ np.linalg.qr(b.T @ basis)[0])[0]
    value, v = np.linalg.eigh((basis.T @ b) @ (b.T @ basis))
    return basis @ v[:, np.argsort(-value)[:rank]]


def alternate(x: np.ndarray, maps: Sequence[Callable[[np.ndarray], np.ndarray]], rounds: int, tol: float) -> np.ndarray:
    """Dykstra's algorithm for the proximal map of a sum from the maps of its terms: each term keeps the correction it last made."""
    owed = [np.zeros_like(x) for _ in maps]
    for _ in range(rounds):
        old = x
        for k, m in enumerate(maps):
            y = x + owed[k]
            x = m(y)
            owed[k] = y - x
        if np.abs(x - old).max(initial=0.0) <= tol * (1.0 + np.abs(old).max(initial=0.0)):
            break
    return x


def shrink_bounded(b: np.ndarray, t: float, lower: np.ndarray | float = 0.0, rounds: int = 50, tol: float = 1e-6, rank: int | None = None) -> np.ndarray:
    """The proximal map of ``t`` times the nuclear norm under an elementwise lower bound, from the input clipped at the bound.

    The last map is the bound's, so the result keeps it.
    """
    if rounds <= 0 or not tol >= 0:
        raise ValueError("a positive number of rounds and a tolerance of zero or more are needed")
    return alternate(np.maximum(b, lower), [lambda y: shrink_singular(y, t, rank), lambda y: np.maximum(y, lower)], rounds, tol)


def shrink_length(x: np.ndarray, t: float) -> np.ndarray:
    """The proximal map of ``t`` times the Euclidean length over the orthant."""
    y = np.maximum(x, 0.0)
    size = float(np.linalg.norm(y))
    return y * max(0.0, 1.0 - t / size) if size > 0 else y


def to_simplex(x: np.ndarray) -> np.ndarray:
    """The nearest point of non-negative values that sum to one."""
    s = np.sort(x)[::-1]
    over = (np.cumsum(s) - 1.0) / np.arange(1, len(x) + 1)
    return np.maximum(x - over[np.flatnonzero(s > over)[-1]], 0.0)
