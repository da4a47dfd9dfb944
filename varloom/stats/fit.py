"""Penalised fits of gene-by-context coefficients from sufficient statistics.

Parameters are ordered: the K x L coefficients row by row, the L context effects (hierarchical model
only), and the residual coefficient tau last. The coefficients carry the penalty; what stands at the
end carries none and is solved exactly for every table of coefficients, so a fit is a descent in the
coefficients alone.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from ..sources.files import Files
from .gram import Quadratic, Rows
from .solve import nuclear, orthant_minimum, shrink_bounded, shrink_length, to_simplex

#: The default penalties and loop constants.
LAMBDAS = (1e3, 3e2, 1e2, 3e1, 1e1, 3.0, 1.0, 3e-1, 1e-1, 3e-2, 1e-2, 3e-3, 1e-3, 3e-4, 1e-4)
HIERARCHICAL_LAMBDAS = (1e6, 1e5, 1e4, 1e3, 3e2, 1e2, 3e1, 1e1)
IMPROVE, PATIENCE, CLIP, LEAST_STEPS = 1e-6, 25, 1.0, 10
WINDOW, WINDOW_TOL = 10, 1e-5
BACKOFF, UPHILL, UPHILL_TOL, FLOOR = 0.5, 5, 1e-5, 128.0
EXTENSIONS, EXTEND_BY, START_TAU = 4, 3.0, 1e-8
#: Factors at the start of a rank-one fit: softplus of -8 and of 0.
START_GENE, START_CONTEXT = math.log1p(math.exp(-8.0)), math.log(2.0)


@dataclass
class Fit:
    method: str
    b: np.ndarray
    tau: float
    effects: np.ndarray | None = None
    effects_se: np.ndarray | None = None
    losses: list[float] = field(default_factory=list)
    info: dict = field(default_factory=dict)

    def beta(self) -> np.ndarray:
        parts = [self.b.ravel()]
        if self.effects is not None:
            parts.append(self.effects)
        return np.append(np.concatenate(parts), self.tau)


@dataclass
class Path:
    method: str
    lambdas: list[float]
    cv_scores: dict[float, float] | None
    best_lambda: float
    fit: Fit
    info: dict = field(default_factory=dict)


class Split:
    """A quadratic loss over coefficients ``b`` and a short end ``c``, with one product by its matrix for each ``b``."""

    def __init__(self, loss: Quadratic, end: int):
        self.loss, self.p, self.n = loss, loss.size - end, max(loss.n, 1)
        self.columns = loss.columns(range(self.p, loss.size))
        self.normal = self.columns[self.p :]
        self._bend: float | None = None

    @staticmethod
    def of(loss: Quadratic, end: int) -> "Split":
        """The split of a loss, made once for all its penalties."""
        kept = loss.__dict__.setdefault("_splits", {})
        if end not in kept:
            kept[end] = Split(loss, end)
        return kept[end]

    def at(self, b: np.ndarray) -> "Place":
        return Place(self, b, self.loss.dot(np.append(b.ravel(), np.zeros(self.loss.size - self.p))))

    def curvature(self, rounds: int = 12) -> float:
        """A bound of the loss's second derivative along the coefficients, by power iteration with a margin; found once."""
        if self._bend is not None:
            return self._bend
        x, top = np.ones(self.p) / math.sqrt(max(self.p, 1)), 0.0
        for _ in range(rounds):
            y = self.loss.dot(np.append(x, np.zeros(self.loss.size - self.p)))[: self.p]
            top = float(np.linalg.norm(y))
            if not top > 0:
                return 1.0
            x = y / top
        self._bend = 2.2 * top / self.n
        return self._bend


@dataclass
class Place:
    """A table of coefficients with what the loss needs to know about it."""

    split: Split
    b: np.ndarray
    product: np.ndarray

    def end_equations(self) -> tuple[np.ndarray, np.ndarray]:
        s = self.split
        return s.normal, s.loss.h[s.p :] - self.product[s.p :]

    def value(self, c: np.ndarray) -> float:
        s, x = self.split, self.b.ravel()
        quad = x @ self.product[: s.p] + 2 * c @ self.product[s.p :] + c @ s.normal @ c
        return float((quad - 2 * (s.loss.h[: s.p] @ x + s.loss.h[s.p :] @ c) + s.loss.q) / s.n)

    def slope(self, c: np.ndarray) -> np.ndarray:
        s = self.split
        return (2 / s.n * (self.product[: s.p] + s.columns[: s.p] @ c - s.loss.h[: s.p])).reshape(self.b.shape)


@dataclass
class Progress:
    """What the rules of a descent look at."""

    values: list[float] = field(default_factory=list)
    moved: float = math.inf
    best: float = math.inf
    idle: int = 0  # steps since the best value

    def note(self, value: float) -> bool:
        """Whether ``value`` is the best so far, by more than rounding."""
        self.values.append(value)
        better = math.isfinite(value) and value < self.best - IMPROVE
        self.best, self.idle = (value, 0) if better else (self.best, self.idle + 1)
        return better


def still(tol: float) -> Callable[[Progress], bool]:
    return lambda p: p.moved < tol


def idle(p: Progress) -> bool:
    return p.idle >= PATIENCE


def flat(p: Progress) -> bool:
    if len(p.values) <= WINDOW:
        return False
    before = p.values[-WINDOW - 1]
    return abs(before - p.values[-1]) < WINDOW_TOL * max(1.0, abs(before))


@dataclass
class Steps:
    """Length of the steps: constant, or shortened (from the best point) when the value keeps rising."""

    length: float
    shortens: bool = False
    rising: int = 0
    cuts: int = 0

    def __post_init__(self) -> None:
        self.least = self.length / FLOOR

    def back(self, p: Progress) -> bool:
        """Whether to go on from the best point with shorter steps."""
        value = p.values[-1]
        rises = p.idle > 0 and math.isfinite(value) and math.isfinite(p.best) and value - p.best > UPHILL_TOL * max(1.0, abs(p.best))
        self.rising = self.rising + 1 if rises else 0
        if not self.shortens or self.rising < UPHILL or self.length <= self.least:
            return False
        self.length, self.cuts, self.rising = max(self.least, BACKOFF * self.length), self.cuts + 1, 0
        return True


def _change(new: np.ndarray, old: np.ndarray) -> float:
    return float(np.linalg.norm(new - old) / (1e-8 + np.linalg.norm(old)))


def descend(
    split: Split, b: np.ndarray, c: np.ndarray, ends: Callable[[np.ndarray, np.ndarray], np.ndarray], bound: Callable[[np.ndarray], np.ndarray | float],
    lam: float, steps: Steps, rules: dict[str, Callable[[Progress], bool]], max_iter: int, clip: float | None, momentum: bool = False, **prox,
) -> tuple[Place, np.ndarray, Progress, str]:
    """Proximal descent: the best place, its end, the progress, and the name of the rule that ended it.

    ``ends`` solves the end's equations, ``bound`` gives the coefficients' lower bound for an end. With
    ``momentum`` a step starts ahead of the place, in the direction of the last one, until the value rises.
    """
    progress, why, ahead, speed = Progress(), "steps", b, 1.0
    best: tuple[Place, np.ndarray] | None = None
    for k in range(max_iter):
        place = split.at(ahead)
        new_c = ends(*place.end_equations())
        value = place.value(new_c) + lam * nuclear(ahead)
        if progress.note(value) or best is None:
            best = place, new_c
        elif steps.back(progress):
            ahead = b = best[0].b
            c = best[1]
            continue
        slope = np.nan_to_num(place.slope(new_c), nan=0.0, posinf=0.0, neginf=0.0)
        if clip is not None:
            slope = np.clip(slope, -clip, clip)
        nxt = shrink_bounded(ahead - steps.length * slope, steps.length * lam, bound(new_c), **prox)
        progress.moved = max(_change(nxt, b), _change(new_c[:-1], c[:-1]) if len(c) > 1 else 0.0)
        if momentum and progress.idle == 0:
            faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
            ahead, speed = np.maximum(nxt + (speed - 1) / faster * (nxt - b), bound(new_c)), faster
        else:
            ahead, speed = nxt, 1.0
        b, c = nxt, new_c
        if k > LEAST_STEPS and (hit := next((n for n, r in rules.items() if r(progress)), None)):
            why = hit
            break
    return *best, progress, why


def _step(split: Split, lr: float | None) -> float:
    return 1.0 / split.curvature() if lr is None else lr


def _info(p: Progress, why: str, steps: Steps) -> dict:
    return {"iterations": len(p.values), "best_objective": p.best, "step": steps.length, "halvings": steps.cuts, "stopped_by": why}


def fit_nuclear(loss: Quadratic, k: int, l: int, lam: float, start: Fit | None = None, lr: float | None = 1e-2, max_iter: int = 500, tol: float = 1e-6, clip: float | None = CLIP, **prox) -> Fit:
    """Non-negative coefficients with a nuclear-norm penalty. Without ``lr`` the step follows the curvature, with momentum and unclipped."""
    split = Split.of(loss, 1)
    b, tau = (np.zeros((k, l)), START_TAU) if start is None else (start.b.copy(), start.tau)
    steps = Steps(_step(split, lr), lr is None)
    place, c, p, why = descend(split, b, np.array([tau]), orthant_minimum, lambda c: 0.0, lam, steps, {"still": still(tol), "idle": idle}, max_iter, None if lr is None else clip, lr is None, **prox)
    return Fit("nuclear", place.b, float(c[0]), losses=p.values, info=_info(p, why, steps))


def _end_solver(mode: str, profile: np.ndarray | None) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Context effects and tau, not negative: all free, one scale of a profile and tau, or tau beside a fixed profile."""
    if mode == "free":
        return orthant_minimum
    # effects = offset + basis @ free coordinates
    l = len(profile)
    basis, offset = np.zeros((l + 1, 2 if mode == "scaled" else 1)), np.zeros(l + 1)
    basis[-1, -1] = 1.0
    if mode == "scaled":
        basis[:l, 0] = profile
    else:
        offset[:l] = profile
    return lambda normal, rhs: offset + basis @ orthant_minimum(basis.T @ normal @ basis, basis.T @ (rhs - normal @ offset))


def jackknife(normals: list[np.ndarray], rhs: list[np.ndarray], solve: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Standard errors from leaving out one block at a time; zero for a single block."""
    whole_n, whole_r = sum(normals), sum(rhs)
    t = np.array([solve(whole_n - a, whole_r - b) for a, b in zip(normals, rhs)])
    n = len(t)
    return np.sqrt((n - 1) / n * ((t - t.mean(axis=0)) ** 2).sum(axis=0))


def fit_hierarchical(
    loss: Quadratic, k: int, l: int, lam: float, start: Fit | None = None, lr: float | None = 3e-7, max_iter: int = 500, tol: float = 1e-6,
    constraint: str = "nonnegative", mode: str = "free", profile: np.ndarray | None = None, profile_se: np.ndarray | None = None,
    clip: float | None = CLIP, adaptive: bool = True, **prox,
) -> Fit:
    """Context effects shared by all genes, with penalised deviations of single genes.

    ``mode``: ``free`` effects, a ``fixed`` profile, or a profile times a fitted scale (``scaled``).
    ``constraint``: deviations ``nonnegative``, or only their sum with the context's effect
    (``total_nonnegative``). ``loss.blocks`` are the jackknife's blocks.
    """
    bounds = {"nonnegative": lambda c: 0.0, "total_nonnegative": lambda c: -c[None, :-1]}
    if constraint not in bounds or mode not in ("free", "fixed", "scaled"):
        raise ValueError("unknown constraint or mode")
    if mode != "free":
        profile = np.asarray(profile, dtype=float)
        if profile.shape != (l,) or not (profile >= 0).all():
            raise ValueError("the profile must hold one non-negative value per context")
    split, solve = Split.of(loss, l + 1), _end_solver(mode, profile)
    b = np.zeros((k, l)) if start is None else start.b.copy()
    known = start.effects if start is not None and start.effects is not None else profile if mode != "free" else np.zeros(l)
    c = np.append(known, START_TAU if start is None else start.tau)
    steps = Steps(_step(split, lr), adaptive)
    rules = {"flat": flat, "idle": idle, "still": still(tol)}
    place, c, p, why = descend(split, b, c, solve, bounds[constraint], lam, steps, rules, max_iter, None if lr is None else clip, lr is None, **prox)
    blocks = [x.end_equations(place.b, l + 1) if isinstance(x, Rows) else Split.of(x, l + 1).at(place.b).end_equations() for x in (loss.blocks or [loss])]
    se = jackknife([n for n, _ in blocks], [r for _, r in blocks], solve)[:-1]
    if profile_se is not None:
        se = _profile_error(mode, np.asarray(profile_se, dtype=float), se, c[:-1], profile)
    return Fit("hierarchical", place.b, float(c[-1]), c[:-1].copy(), se, p.values, _info(p, why, steps) | {"jackknife_blocks": len(blocks)})


def _profile_error(mode: str, given: np.ndarray, found: np.ndarray, effects: np.ndarray, profile: np.ndarray | None) -> np.ndarray:
    """The profile's own error for a fixed one; for a scaled one its scaled error together with the scale's."""
    if mode == "fixed":
        return given
    if mode == "free" or not (profile > 0).any():
        return found
    return np.sqrt((float(np.median((effects / np.where(profile > 0, profile, np.nan))[profile > 0])) * given) ** 2 + found**2)


def rank1_factors(b: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative factors of the leading singular pair of the positive part, which are positive by themselves (Perron)."""
    x = np.maximum(b, 0.0)
    w = x.sum(axis=0)
    for _ in range(rounds):
        size = np.linalg.norm(w)
        if not size > 0:
            return np.zeros(b.shape[0]), np.zeros(b.shape[1])
        last, w = w / size, x.T @ (x @ (w / size))
        if np.linalg.norm(w / max(np.linalg.norm(w), 1e-300) - last) < 1e-13:
            break
    w = w / np.linalg.norm(w)
    s = x @ w
    root = math.sqrt(np.linalg.norm(s))
    return s / root, w * root


def fit_rank1(loss: Quadratic, k: int, l: int, lam: float, s0: np.ndarray | None = None, w0: np.ndarray | None = None, tau: float = START_TAU, lr: float | None = None, max_iter: int = 500, tol: float = 1e-6, simplex: bool = False) -> Fit:
    """Coefficients as an outer product of non-negative factors, penalised by the product of their lengths.

    The factors are improved in turn, each by a proximal step that is as long as the loss's curvature
    along it allows (``lr`` at most); tau is exact. ``simplex`` keeps the contexts' factor on the simplex.
    """
    split = Split.of(loss, 1)
    s = np.full(k, START_GENE) if s0 is None else np.maximum(np.asarray(s0, dtype=float), 0.0)
    w = np.full(l, START_CONTEXT) if w0 is None else np.maximum(np.asarray(w0, dtype=float), 0.0)
    w = to_simplex(w) if simplex else w
    progress, why = Progress(), "steps"
    best, before = None, None
    for it in range(max_iter):
        place = split.at(np.outer(s, w))
        c = orthant_minimum(*place.end_equations())
        if progress.note(place.value(c) + lam * float(np.linalg.norm(s) * np.linalg.norm(w))) or best is None:
            best = s, w, c
        slope, gene = place.slope(c), it % 2 == 0
        d = slope @ w if gene else slope.T @ s
        along = np.outer(d, w) if gene else np.outer(s, d)
        bend = 2 / split.n * split.loss.square(np.append(along.ravel(), np.zeros(split.loss.size - split.p)))
        t = float(along.ravel() @ slope.ravel()) / bend if bend > 0 else 0.0
        t = t if lr is None else min(t, lr)
        if gene:
            s = shrink_length(s - t * d, t * lam * float(np.linalg.norm(w)))
        elif simplex:
            w = to_simplex(w - t * d)
        else:
            w = shrink_length(w - t * d, t * lam * float(np.linalg.norm(s)))
        now = np.outer(s, w)
        progress.moved = math.inf if before is None else _change(now, before)
        before = now if not gene else before
        if it > 2 * LEAST_STEPS and not gene and (progress.moved < tol or idle(progress)):
            why = "still" if progress.moved < tol else "idle"
            break
    s, w, c = best
    return Fit("rank1", np.outer(s, w), float(c[0]), losses=progress.values, info={"iterations": len(progress.values), "best_objective": progress.best, "stopped_by": why})


def held_out(score: Quadratic, fit: Fit) -> float:
    """Mean squared error over the rows of an unweighted Gram."""
    return score.loss(fit.beta())


def fit_one(method: str, loss: Quadratic, k: int, l: int, lam: float, prev: Fit | None, kw: dict, first_profile: dict) -> Fit:
    """One penalty's fit, from the one before it."""
    if method == "nuclear":
        return fit_nuclear(loss, k, l, lam, prev, **kw)
    kw = dict(kw)
    if method == "rank1":
        given = kw.pop("b0", None)
        s0, w0 = rank1_factors(prev.b) if prev is not None else rank1_factors(given) if given is not None else (None, None)
        return fit_rank1(loss, k, l, lam, s0, w0, START_TAU if prev is None else prev.tau, **kw)
    if kw.pop("freeze", False) and kw.get("mode") == "scaled" and prev is not None:
        # the scale is fitted at the largest penalty and kept
        kw |= {"mode": "fixed", "profile": prev.effects, "profile_se": first_profile.setdefault(id(loss), prev.effects_se)}
    return fit_hierarchical(loss, k, l, lam, prev, **kw)


def cross_validate(
    method: str, whole: Quadratic, folds: dict[int, Quadratic], scores: dict[int, Quadratic], k: int, l: int, lambdas: list[float],
    extend: int = EXTENSIONS, store: "CheckpointStore | None" = None, **kw,
) -> dict[float, float]:
    """Mean held-out error of each penalty over the folds, along paths of falling penalties.

    While the smallest penalty is the best (and the method is not rank1), the paths are continued
    with a third of it, ``extend`` times at most. ``store`` keeps each fold's state and scores, and
    a later call with the same contract resumes there.
    """
    order = sorted({float(x) for x in lambdas}, reverse=True)
    use = [f for f in sorted(folds) if f in scores and scores[f].n]
    train = {f: whole - folds[f] for f in use}
    got: dict[float, dict[int, float]] = {}
    state: dict[int, Fit | None] = {f: None for f in use}
    frozen: dict = {}

    def advance(lam: float) -> None:
        got[lam] = {}
        for f in use:
            kept = store.get(f, lam) if store else None
            if kept is None:
                fit = fit_one(method, train[f], k, l, lam, state[f], kw, frozen)
                kept = (fit, held_out(scores[f], fit))
                if store:
                    store.put(f, lam, *kept)
            state[f], got[lam][f] = kept

    for lam in order:
        advance(lam)
    mean = lambda: {lam: float(np.mean(list(s.values()))) for lam, s in got.items() if s}
    for _ in range(extend if method != "rank1" else 0):
        m = mean()
        if not m or min(m, key=m.get) != min(m):
            break
        advance(min(m) / EXTEND_BY)
    return mean()


def fit_path(method: str, whole: Quadratic, k: int, l: int, lambdas: list[float], cv: tuple[dict[int, Quadratic], dict[int, Quadratic]] | dict[float, float] | None = None, extend: int = EXTENSIONS, store: "CheckpointStore | None" = None, **kw) -> Path:
    """Cross-validate (or take the means of a validation), then fit all rows from the largest penalty down to the best one."""
    means = cv if isinstance(cv, dict) else cross_validate(method, whole, cv[0], cv[1], k, l, lambdas, extend, store, **kw) if cv else None
    order = sorted(means if means else {float(x) for x in lambdas}, reverse=True)
    best = min(means, key=means.get) if means else order[-1]
    fit, frozen = None, {}
    for lam in order:
        fit = fit_one(method, whole, k, l, lam, fit, kw, frozen)
        if lam == best:
            break
    return Path(method, order, means, best, fit, {"extensions": max(0, len(order) - len({float(x) for x in lambdas}))})


class CheckpointStore:
    """Fold states of a cross-validation in one JSON file per fold, under a contract that must match.

    Files are written aside and renamed, so a run that is cut off leaves whole files behind. The folder
    may be on any file system that the session's Hadoop configuration knows.
    """

    def __init__(self, folder: str, contract: dict):
        self.files, self.contract = Files(folder), json.loads(json.dumps(contract))
        kept = self.files.read_json("contract.json")
        if kept is None:
            self.files.write_json("contract.json", self.contract)
        elif kept != self.contract:
            raise ValueError("the checkpoint was made under another contract")

    def get(self, fold: int, lam: float) -> tuple[Fit, float] | None:
        x = (self.files.read_json(f"fold-{fold}.json") or {}).get(repr(lam))
        if x is None:
            return None
        arr = lambda v: None if v is None else np.array(v, dtype=float)
        return Fit(x["method"], arr(x["b"]), x["tau"], arr(x["effects"]), arr(x["effects_se"])), x["score"]

    def put(self, fold: int, lam: float, fit: Fit, score: float) -> None:
        kept = self.files.read_json(f"fold-{fold}.json") or {}
        lst = lambda v: None if v is None else np.asarray(v).tolist()
        kept[repr(lam)] = {"method": fit.method, "b": lst(fit.b), "tau": fit.tau, "effects": lst(fit.effects), "effects_se": lst(fit.effects_se), "score": score}
        self.files.write_json(f"fold-{fold}.json", kept)


def merge_stores(folders: list[str], folds: list[int], lambdas: list[float]) -> dict[float, float]:
    """Mean scores over fold shards kept in several folders; contracts must agree and no fold may miss a penalty."""
    contracts, scores = [], {}
    for folder in folders:
        files = Files(folder)
        contracts.append(files.read_json("contract.json"))
        for fold in folds:
            scores.setdefault(fold, {}).update({float(lam): x["score"] for lam, x in (files.read_json(f"fold-{fold}.json") or {}).items()})
    if any(c != contracts[0] for c in contracts):
        raise ValueError("the shards were made under different contracts")
    missing = [(f, lam) for f in folds for lam in lambdas if lam not in scores.get(f, {})]
    if missing:
        raise ValueError(f"incomplete: {missing[:5]}")
    return {lam: float(np.mean([scores[f][lam] for f in folds])) for lam in lambdas}
