import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varloom.plans import lens, models
from varloom.session import RELEASE, Scratch
from varloom.stats import gram as gm, simulate as sim, sldsc
from varloom.stats.fit import CheckpointStore, Fit, cross_validate, fit_hierarchical, fit_nuclear, fit_path, fit_rank1, merge_stores, rank1_factors
from varloom.stats.report import json_safe, summarize_run
from varloom.stats.solve import leading_subspace, nuclear, orthant_minimum, shrink_bounded, shrink_length, shrink_singular, to_simplex

DATA = "/root/testdata/sf0.001"


def test_orthant_minimum_reaches_the_conditions_of_optimality():
    rng = np.random.default_rng(0)
    for t in range(60):
        a, b = rng.normal(size=(30, 6)) * 10.0 ** rng.integers(-4, 4, 6), rng.normal(size=30)
        if t % 3 == 0:
            a[:, 4] = a[:, 2]  # two columns that are the same
        if t % 5 == 0:
            a[:, 1] = 0
        x = orthant_minimum(a.T @ a, a.T @ b)
        g = (a.T @ (b - a @ x)) / np.maximum(np.linalg.norm(a, axis=0), 1e-300)
        assert (x >= 0).all() and (g <= 1e-7).all() and abs((a.T @ (b - a @ x)) @ x) < 1e-7
    assert orthant_minimum(np.zeros((2, 2)), np.ones(2)).tolist() == [0, 0]


def test_simplex_and_length():
    x = to_simplex(np.array([0.4, 2.0, -1.0]))
    assert x.sum() == pytest.approx(1) and (x >= 0).all() and x[1] == 1
    assert np.allclose(shrink_length(np.array([3.0, 4.0, -1.0]), 1.0), [2.4, 3.2, 0]) and not shrink_length(np.array([0.1, -1.0]), 1.0).any()


def test_shrinkage():
    rng = np.random.default_rng(1)
    for shape in ((7, 3), (3, 7)):
        b = rng.normal(size=shape)
        u, s, vt = np.linalg.svd(b, full_matrices=False)
        assert np.allclose(shrink_singular(b, 0.5), (u * np.maximum(s - 0.5, 0)) @ vt)
    low = rng.normal(size=(80, 2)) @ rng.normal(size=(2, 70))
    q = leading_subspace(low, 2)
    assert np.allclose(q @ (q.T @ low), low) and np.allclose(shrink_singular(low, 0.5, rank=2), shrink_singular(low, 0.5))
    assert nuclear(low) == pytest.approx(np.linalg.svd(low, compute_uv=False).sum())
    v, lower, t = np.array([[0.8, -0.7], [-0.5, 0.4], [0.2, -0.3]]), np.array([-0.2, -0.1]), 0.35
    x = shrink_bounded(v, t, lower, rounds=200, tol=1e-8)
    objective = lambda m: 0.5 * ((m - v) ** 2).sum() + t * nuclear(m)
    assert (x >= lower - 1e-9).all() and (x < 0).any() and objective(x) <= objective(np.maximum(shrink_singular(v, t), lower)) + 1e-5


def toy_grams(k=3, l=2, n=240, seed=3, folds=4):
    rng = np.random.default_rng(seed)
    b = np.outer(rng.random(k), rng.random(l))
    x = rng.random((n, k * l + 1))
    y = x[:, :-1] @ b.ravel() + 0.05 * x[:, -1] + 0.01 * rng.normal(size=n)
    f = np.arange(n) % folds
    mk = lambda m: gm.Gram(x[m].T @ x[m], x[m].T @ y[m], float(y[m] @ y[m]), int(m.sum()))
    parts = {i: mk(f == i) for i in range(folds)}
    return b, x, y, gm.total(list(parts.values())), parts


def test_nuclear_fit_and_gradient():
    b, x, y, g, _ = toy_grams()
    beta = np.random.default_rng(0).random(7)
    assert g.loss(beta) == pytest.approx(((y - x @ beta) ** 2).mean())
    num = [(g.loss(beta + 1e-6 * e) - g.loss(beta - 1e-6 * e)) / 2e-6 for e in np.eye(7)]
    assert np.allclose(num, g.gradient(beta), atol=1e-6)
    fit = fit_nuclear(g, 3, 2, 1e-5, lr=0.1, max_iter=4000, tol=1e-9)
    assert np.allclose(fit.b, b, atol=0.05) and (fit.b >= 0).all() and fit.losses[-1] <= fit.losses[0]
    assert np.abs(fit_nuclear(g, 3, 2, 1e3, lr=0.1).b).max() < 1e-6
    # steps by the curvature come at least as far in fewer steps
    own = fit_nuclear(g, 3, 2, 1e-3, lr=None, max_iter=2000, tol=1e-10)
    slow = fit_nuclear(g, 3, 2, 1e-3, lr=0.05, max_iter=20000, tol=1e-10)
    assert own.info["best_objective"] <= slow.info["best_objective"] and len(own.losses) < len(slow.losses)


def test_rank1_recovers_a_rank_one_table():
    b, _, _, g, _ = toy_grams()
    s, w = rank1_factors(b)
    assert np.allclose(np.outer(s, w), b, atol=1e-9)
    fit = fit_rank1(g, 3, 2, 1e-6, s, w, lr=1e-2, max_iter=800, tol=1e-10)
    assert np.allclose(fit.b, b, atol=0.05)
    simplex = fit_rank1(g, 3, 2, 1e-6, s, w, lr=1e-2, max_iter=50, simplex=True)
    assert np.linalg.matrix_rank(simplex.b, tol=1e-8) == 1


def hierarchical_toy():
    # four annotated rows (identity) and four rows of the residual alone
    a = np.zeros((8, 4))
    a[:4] = np.eye(4)
    ctx = np.array([[1, 0], [0, 1], [1, 0], [0, 1]] + [[0, 0]] * 4, dtype=float)
    eff, dev, n = np.array([0.08, 0.06]), np.array([[-0.03, 0.02], [0.01, -0.02]]), 100
    x = n * np.hstack([a, ctx, np.ones((8, 1))])
    y = x @ np.concatenate([dev.ravel(), eff, [0.0]])
    return gm.Gram(x.T @ x, x.T @ y, float(y @ y), 8), eff, dev


def test_hierarchical_signed_deviations():
    g, eff, dev = hierarchical_toy()
    start = Fit("hierarchical", dev, 0.0, eff)
    fit = fit_hierarchical(g, 2, 2, 0.0, start, lr=1e-6, max_iter=50, constraint="total_nonnegative", mode="fixed", profile=eff)
    assert np.allclose(fit.b, dev, atol=1e-6) and np.allclose(fit.effects, eff) and fit.tau == pytest.approx(0, abs=1e-8)
    assert ((fit.effects + fit.b) >= -1e-9).all()
    free = fit_hierarchical(g, 2, 2, 1e9, lr=1e-6, max_iter=30)
    assert np.abs(free.b).max() < 1e-6 and (free.effects >= 0).all() and (free.effects_se == 0).all()
    scaled = fit_hierarchical(g, 2, 2, 1e9, lr=1e-6, max_iter=30, mode="scaled", profile=eff / 2)
    assert scaled.effects[0] / scaled.effects[1] == pytest.approx(eff[0] / eff[1])
    for bad in ({"mode": "other"}, {"constraint": "x"}, {"mode": "fixed", "profile": [1.0]}):
        with pytest.raises(ValueError):
            fit_hierarchical(g, 2, 2, 1.0, **bad)


def test_cross_validation_checkpoints_and_merge(tmp_path):
    _, _, _, g, parts = toy_grams()
    kw = dict(lr=0.1, max_iter=200)
    plain = cross_validate("nuclear", g, parts, parts, 3, 2, [1.0, 0.1], extend=2, **kw)
    assert len(plain) > 2 and min(plain, key=plain.get) != 1.0
    contract = {"k": 3, "l": 2, "lambdas": [1.0, 0.1]}
    store = CheckpointStore(str(tmp_path / "a"), contract)
    first = cross_validate("nuclear", g, parts, parts, 3, 2, [1.0, 0.1], 2, store, **kw)
    again = cross_validate("nuclear", g, parts, parts, 3, 2, [1.0, 0.1], 2, CheckpointStore(str(tmp_path / "a"), contract), lr=9.9, max_iter=1)
    assert first == plain == again
    with pytest.raises(ValueError):
        CheckpointStore(str(tmp_path / "a"), contract | {"k": 4})
    for name, use in (("s0", [0, 1]), ("s1", [2, 3])):
        sub = {f: parts[f] for f in use}
        cross_validate("nuclear", g, sub, sub, 3, 2, [1.0, 0.1], 0, CheckpointStore(str(tmp_path / name), contract), **kw)
    merged = merge_stores([str(tmp_path / "s0"), str(tmp_path / "s1")], [0, 1, 2, 3], [1.0, 0.1])
    assert merged[1.0] == pytest.approx(plain[1.0])
    with pytest.raises(ValueError):
        merge_stores([str(tmp_path / "s0")], [0, 1, 2, 3], [1.0])
    path = fit_path("nuclear", g, 3, 2, [1.0, 0.1], (parts, parts), **kw)
    assert path.best_lambda == min(path.cv_scores, key=path.cv_scores.get)
    g2, eff, _ = hierarchical_toy()
    p = fit_path("hierarchical", g2, 2, 2, [10.0, 1.0], lr=1e-6, max_iter=20, mode="scaled", profile=eff, freeze=True)
    assert p.fit.effects is not None


def test_distributed_gram_equals_numpy(spark):
    rng = np.random.default_rng(5)
    n, p = 60, 7
    x = rng.normal(size=(n, p)) * (rng.random((n, p)) < 0.5)
    y, w = rng.normal(size=n), rng.random(n)
    cells = [(int(i % 2), int(i // 20), int(i), int(j), float(x[i, j]), float(y[i]), float(w[i])) for i in range(n) for j in range(p) if x[i, j]]
    df = spark.createDataFrame(cells, "fold int, region long, row long, p long, x double, y double, w double")
    got = gm.fetch(gm.gram_entries(df, ["fold"]), p, "fold")
    for f in (0, 1):
        m = (np.arange(n) % 2 == f) & (x != 0).any(axis=1)
        assert np.allclose(got[f].g, x[m].T @ (w[m, None] * x[m])) and np.allclose(got[f].h, x[m].T @ (w[m] * y[m]))
        assert got[f].q == pytest.approx((w[m] * y[m] ** 2).sum()) and got[f].n == m.sum()
    with pytest.raises(ValueError):
        gm.load(pd.DataFrame(columns=["p", "q", "value"]), gm.MOST_PARAMS + 1)


def test_sparse_gram_is_the_dense_one():
    _, x, y, g, parts = toy_grams()
    up = np.triu(g.columns(range(7)))
    i, j = np.nonzero(up)
    sparse = gm.SparseGram(i, j, up[i, j], g.h, g.q, g.n)
    beta = np.random.default_rng(0).random(7)
    assert np.allclose(sparse.dot(beta), g.dot(beta)) and np.allclose(sparse.columns([5, 6]), g.columns([5, 6]))
    rest = g - parts[0]
    assert np.allclose(rest.dot(beta), sum(parts[f].dot(beta) for f in (1, 2, 3))) and rest.n == 180
    assert np.allclose(fit_nuclear(sparse, 3, 2, 1e-3).b, fit_nuclear(g, 3, 2, 1e-3).b)


def test_hundred_thousand_parameters():
    rng = np.random.default_rng(0)
    k, l = 12_500, 8
    b = np.outer(rng.random(k), rng.random(l)) * (rng.random((k, 1)) < 0.2)
    # every gene meets the contexts of its own and of the next gene
    p = k * l
    i = np.concatenate([np.arange(p), np.arange(p - l), [p]])
    j = np.concatenate([np.arange(p), np.arange(p - l) + l, [p]])
    v = np.concatenate([np.full(p, 2.0), np.full(p - l, 0.3), [1.0]])
    g = gm.SparseGram(i, j, v, np.zeros(p + 1), 0.0, k)
    truth = np.append(b.ravel(), 0.0)
    g.h = g.dot(truth)
    g.q = float(truth @ g.h)
    fit = fit_nuclear(g, k, l, 1e-6, lr=None, max_iter=60)
    assert np.abs(fit.b - b).max() < 0.05
    w = fit_rank1(g, k, l, 1e-6, *rank1_factors(b + 0.01), max_iter=40)
    assert w.losses[-1] < w.losses[0]


def test_sldsc_recovers_the_truth(spark):
    scores = np.array([[1, 0], [0, 1], [2, 1], [1, 3], [0.5, 2], [3, 0.2]])
    truth = np.array([0.10, 0.20, 0.03])
    chisq = 1 + 1000 * (scores @ truth[:2] + truth[2])
    m = spark.createDataFrame([(i, i, 1.0) for i in range(6)], "row_idx long, col_idx long, r2 double")
    s = spark.createDataFrame([(i, k, float(scores[i, k])) for i in range(6) for k in range(2)], "variant_idx long, mechanism_idx long, value double")
    g = spark.createDataFrame([(i, float(c)) for i, c in enumerate(chisq)] + [(6, None), (7, float("nan"))], "variant_idx long, chisq double")
    fits = sldsc.fit(m, s, g, [0, 1], ["a", "b"], 1000)
    assert np.allclose(fits["joint"].coefficients, truth, atol=1e-7) and fits["joint"].n_variants == 6
    assert fits["joint"].implied_h2[0] == pytest.approx(0.1 * scores[:, 0].sum()) and fits["a"].names == ["a", "residual_ld_score"]
    prof = sldsc.context_profile(pd.DataFrame({"name": ["a", "b"], "coefficient": [0.5, -1.0]}), ["a", "b"])
    assert prof["effect"].tolist() == [0.5, 0.0]
    with pytest.raises(ValueError):
        sldsc.context_profile(pd.DataFrame({"name": ["a"], "coefficient": [0.5]}), ["a", "b"])


def test_simulation(spark):
    sc = [[1, 0], [2, 3], [4, 5], [0, 7]]
    s = spark.createDataFrame([(i, k, float(v)) for i, r in enumerate(sc) for k, v in enumerate(r)], "variant_idx long, mechanism_idx long, value double")
    t = {r.variant_idx: r.direct_h2 for r in sim.sparse_truth(s, {0: 0.14, 1: 0.06}, 1.0, 7).collect()}
    assert sum(t.values()) == pytest.approx(0.20) and t[0] == pytest.approx(0.02) and t[3] == pytest.approx(0.06 * 7 / 15)
    big = spark.range(5000).select(F.col("id").alias("variant_idx"), F.lit(0).cast("long").alias("mechanism_idx"), F.lit(1.0).alias("value"))
    a = sim.sparse_truth(big, {0: 0.5}, 0.1, 1)
    assert a.count() == 500 and sorted(a.collect()) == sorted(sim.sparse_truth(big, {0: 0.5}, 0.1, 1).collect())
    with pytest.raises(ValueError):
        sim.sparse_truth(s, {5: 0.1}, 0.5, 1)
    x = spark.range(20000).select("id", F.lit(3.0).alias("nc")).select(sim.noncentral_chisq("nc", 5, ["id"]).alias("c")).agg(F.avg("c"), F.var_pop("c")).first()
    assert x[0] == pytest.approx(4.0, rel=0.05) and x[1] == pytest.approx(2 * (1 + 2 * 3), rel=0.1)
    r = sim.recovery(np.array([[3.0, 1.0, 0.0], [3.0, 1.0, 0.0]]), np.array([0.7, 0.3, 0.0]), [0, 1, 2])
    assert r["top_two_exact"] and r["causal_mass"] == 1.0 and r["l1_error"] == pytest.approx(0.1)


def test_report():
    c = pd.DataFrame({"context": ["intercept", "microglia", "neuron"], "total_h2": [0.2, 0.6, 0.2], "fraction": [0.2, 0.6, 0.2]})
    r = summarize_run({1e6: 5, 10: 4, 1: 4.5}, 10, c, "microglia")
    assert r["improvement"] == 1.0 and r["leading_biological_fraction"] == pytest.approx(0.75) and r["expected_leads"]
    for bad in (({}, 10, c), ({1.0: float("nan")}, 1.0, c), ({1.0: 2.0}, 3.0, c), ({1.0: 2.0}, 1.0, c.drop(columns="fraction"))):
        with pytest.raises(ValueError):
            summarize_run(*bad, "x")
    assert json_safe({1: np.float64("nan"), "a": np.arange(2), "b": (1, float("inf"))}) == {"1": None, "a": [0, 1], "b": [1, None]}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_sldsc_fit_has_a_model_of_every_context(spark):
    names = [f"c{c}" for c in range(1, 10)]
    got = models.sldsc_fit(spark, DATA).collect() + models.sldsc_joint_fit(spark, DATA).collect()
    of = lambda m: [r.name for r in got if r.model == m]
    assert {r.model for r in got} == {*names, "joint"} and of("joint") == [*names, "residual_ld_score"]
    assert all(of(n) == [n, "residual_ld_score"] for n in names) and all(np.isfinite(r.coefficient) for r in got)
    # the normal equations by hand: c4 alone
    t, m = lens.triples(spark, DATA).where("mechanism_idx = 4").groupBy("variant_idx").agg(F.sum("value").alias("v")).toPandas(), lens.matrix(spark, DATA).toPandas()
    v = m["col_idx"].map(dict(zip(t["variant_idx"], t["v"]))).fillna(0.0)
    x = pd.DataFrame({"a": 0.1 * (m["r2"] * v).groupby(m["row_idx"]).sum(), "b": 0.1 * m.groupby("row_idx")["r2"].sum()})
    g = models._gwas(spark, DATA).toPandas().set_index("variant_idx")["chisq"]
    x = x.join(g, how="inner")
    w = np.sqrt(1 / np.maximum(x["chisq"], 1)).to_numpy()
    want = np.linalg.lstsq(x[["a", "b"]].to_numpy() * w[:, None], (x["chisq"] - 1).to_numpy() * w, rcond=None)[0]
    assert np.allclose([r.coefficient for r in got if r.model == "c4"], want, atol=1e-6)


def test_folds_in_tasks_equal_folds_on_the_driver(spark):
    rng = np.random.default_rng(7)
    k, l, n = 3, 2, 90
    x = rng.random((n, k * l + 1)) * (rng.random((n, k * l + 1)) < 0.7)
    x[:, -1] = rng.random(n) + 0.1
    y, w = x[:, :-1] @ np.outer(rng.random(k), rng.random(l)).ravel() + 0.1 * x[:, -1], rng.random(n) + 0.5
    cells = [(int(i % 3), int(i % 5), int(i), int(j), float(x[i, j]), float(y[i]), float(w[i])) for i in range(n) for j in range(k * l + 1) if x[i, j]]
    df = spark.createDataFrame(cells, "fold int, region long, row long, p long, x double, y double, w double")
    e = gm.gram_entries(df, ["fold"], "region", unweighted=True)
    kw = dict(lr=None, max_iter=60, tol=1e-8)
    got = models.validate_folds(e, "nuclear", k, l, [1.0, 0.1], 2, **kw)
    mk = lambda m, v: gm.Gram(x[m].T @ (v[m, None] * x[m]), x[m].T @ (v[m] * y[m]), float(v[m] @ (y[m] ** 2)), int(m.sum()))
    folds = {f: mk(np.arange(n) % 3 == f, w) for f in range(3)}
    scores = {f: mk(np.arange(n) % 3 == f, np.ones(n)) for f in range(3)}
    whole = mk(np.ones(n, dtype=bool), w)
    want = cross_validate("nuclear", whole, folds, scores, k, l, [1.0, 0.1], 2, **kw)
    assert got.keys() == want.keys() and all(got[lam] == pytest.approx(want[lam], rel=1e-6) for lam in got)
    assert len(got) > 2
    with pytest.raises(ValueError):
        gm.bounded(e, gm.MOST_PARAMS + 1)


def row_design(spark, n=90, k=3, l=2, extra=0, seed=7):
    rng = np.random.default_rng(seed)
    x = rng.random((n, k * l + extra + 1)) * (rng.random((n, k * l + extra + 1)) < 0.7)
    x[:, -1] = rng.random(n) + 0.1
    y, w = x[:, : k * l] @ np.outer(rng.random(k), rng.random(l)).ravel() + 0.1 * x[:, -1], rng.random(n) + 0.5
    w[3] = 0.0
    cells = [(int(i % 3), int(i % 5), int(i), int(j), float(x[i, j]), float(y[i]), float(w[i])) for i in range(n) for j in range(x.shape[1]) if x[i, j]]
    return x, y, w, spark.createDataFrame(cells, "fold int, chrom int, row long, p long, x double, y double, w double")


def test_rows_are_the_gram_without_a_bound(spark, monkeypatch):
    x, y, w, df = row_design(spark)
    monkeypatch.setattr(gm, "MOST_PARAMS", 5)  # the Gram is refused
    monkeypatch.setattr(gm, "IN_MEMORY", 100)
    monkeypatch.setattr(gm, "CHUNK", 60)
    got = gm.rows_of(gm.pack(df, "chrom").toLocalIterator(), 7, True)
    g = gm.Gram(x.T @ (w[:, None] * x), x.T @ (w * y), float(w @ y**2), 89)
    beta = np.random.default_rng(0).random(7)
    assert len(got.chunks) > 1 and got.n == 89 and got.q == pytest.approx(g.q) and np.allclose(got.h, g.h)
    assert np.allclose(got.dot(beta), g.dot(beta)) and got.loss(beta) == pytest.approx(g.loss(beta)) and np.allclose(got.columns([2, 6]), g.columns([2, 6]))
    a, b = fit_nuclear(got, 3, 2, 1e-3, lr=None), fit_nuclear(g, 3, 2, 1e-3, lr=None)
    assert np.allclose(a.b, b.b) and a.tau == pytest.approx(b.tau)
    fit = models._fit(df, "nuclear", 3, 2, [1e-3], lr=None).toPandas()
    b = fit_nuclear(g, 3, 2, 1e-3, lr=None, tol=models.TOL)
    assert np.allclose(fit["coefficient"], np.append(b.b.ravel(), b.tau)) and fit["kind"].tolist() == ["deviation"] * 6 + ["tau"]


def test_hierarchical_rows_have_the_jackknife_blocks(spark, monkeypatch):
    x, y, w, df = row_design(spark, extra=2)
    monkeypatch.setattr(gm, "MOST_PARAMS", 5)
    got = gm.rows_of(gm.pack(df, "chrom").toLocalIterator(), 9, True)
    at = np.arange(90) % 5
    mk = lambda m: gm.Gram(x[m].T @ (w[m, None] * x[m]), x[m].T @ (w[m] * y[m]), float(w[m] @ y[m] ** 2), int((w[m] != 0).sum()))
    want = fit_hierarchical(gm.total([mk(at == c) for c in range(5)]), 3, 2, 0.1, lr=None)
    fit = fit_hierarchical(got, 3, 2, 0.1, lr=None)
    assert len(got.blocks) == 5 and np.allclose(fit.b, want.b) and np.allclose(fit.effects, want.effects) and np.allclose(fit.effects_se, want.effects_se) and fit.tau == pytest.approx(want.tau)


def test_rows_in_tasks_score_the_folds_of_more_parameters_than_a_gram_may_have(spark, monkeypatch):
    x, y, w, df = row_design(spark)
    monkeypatch.setattr(gm, "MOST_PARAMS", 5)
    kw = dict(lr=None, max_iter=60, tol=1e-8)
    got = models.validate_rows(df, "nuclear", 3, 2, [1.0, 0.1], 2, **kw)
    mk = lambda m, v: gm.Gram(x[m].T @ (v[m, None] * x[m]), x[m].T @ (v[m] * y[m]), float(v[m] @ (y[m] ** 2)), int((v[m] != 0).sum()))
    f = np.arange(90) % 3
    want = cross_validate("nuclear", mk(f >= 0, w), {i: mk(f == i, w) for i in range(3)}, {i: mk(f == i, (w != 0).astype(float)) for i in range(3)}, 3, 2, [1.0, 0.1], 2, **kw)
    assert got.keys() == want.keys() and all(got[lam] == pytest.approx(want[lam], rel=1e-6) for lam in got)


def test_rank1_from_rows(spark, monkeypatch):
    x, y, w, df = row_design(spark)
    monkeypatch.setattr(gm, "MOST_PARAMS", 5)
    g = gm.Gram(x.T @ (w[:, None] * x), x.T @ (w * y), float(w @ y**2), 89)
    fit = models._fit(df, "rank1", 3, 2, [1.0, 1e-3]).toPandas()
    want = fit_path("rank1", g, 3, 2, [1.0, 1e-3], max_iter=models.MAX_ITER, tol=models.TOL).fit
    assert np.allclose(fit["coefficient"], want.beta()) and (fit["best_lambda"] == 1e-3).all()


def test_rows_of_a_design_are_made_without_a_shuffle_of_products(spark, monkeypatch):
    from varloom.operators import sparse as sp

    rng = np.random.default_rng(5)
    n, k, l = 80, 4, 2
    m = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.1), 1)
    m = m + m.T + np.eye(n)
    a = rng.random((n, k * l)) * (rng.random((n, k * l)) < 0.3)
    a[70:] = 0  # vectors without an entry
    cells = lambda x, names: spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], names)
    rows = spark.createDataFrame([(i, i % 3, None if i == 7 else i % 5, i % 2, float(i), 1.0 + i) for i in range(0, n, 2)], "row long, fold int, chrom int, region long, y double, w double")
    monkeypatch.setattr(sp, "SPAN", 32)
    monkeypatch.setattr(sp, "PRODUCTS", 64)
    for extra in (0, l):
        x = sp.row_lists(cells(m, "row_idx long, col_idx long, r2 double"), cells(a, "variant_idx long, p long, value double"), rows, 0.1, k * l + extra, extra)
        got = np.zeros((n, k * l + extra + 1))
        for r in x.collect():
            assert (r.y, r.w, r.fold) == (r.row, 1 + r.row, r.row % 3) and r.ps == sorted(set(r.ps))
            got[r.row, r.ps] = r.xs
        want = 0.1 * np.hstack([m @ a, *([m @ a.reshape(n, k, l).sum(axis=1)] if extra else []), m.sum(axis=1, keepdims=True)])
        want[1::2] = 0
        assert np.allclose(got, want)


def test_a_null_block_is_a_block_of_its_own(spark):
    df = row_design(spark)[3].withColumn("chrom", F.when(F.col("chrom") > 0, F.col("chrom")))
    assert len(gm.rows_of(gm.pack(df, "chrom").toLocalIterator(), 7, True).blocks) == 5


def test_the_curvature_of_a_rank_one_step_needs_no_product_back(spark, monkeypatch):
    x, y, w, df = row_design(spark)
    rows = gm.rows_of(gm.pack(df).toLocalIterator(), 7, False)
    beta = np.random.default_rng(1).random(7)
    assert rows.square(beta) == pytest.approx(beta @ rows.dot(beta))
    back = []
    monkeypatch.setattr(gm.Chunk, "back", lambda c, u, out, f=gm.Chunk.back: (back.append(1), f(c, u, out)))
    fit = fit_rank1(rows, 3, 2, 1e-3, max_iter=30)
    assert fit.info["iterations"] == 30 and len(back) <= 32  # one a step, the response and the end's column


def test_the_whole_gram_is_made_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(gm, "TILE", 3)
    monkeypatch.setattr(gm, "ROWS", 7)
    rng = np.random.default_rng(2)
    x = rng.random((90, 12)) * (rng.random((90, 12)) < 0.5)
    for j in range(4):
        x[np.arange(90) % 5 != j, j] = 0  # parameters of one group
    y, w = rng.random(90), rng.random(90) + 0.5
    w[4] = 0
    rows = [(None if i % 5 == 2 else i % 5, 1, i, [int(j) for j in np.flatnonzero(x[i])], [float(v) for v in x[i][x[i] != 0]], float(y[i]), float(w[i])) for i in range(90)]
    df = spark.createDataFrame(rows, "chrom int, region long, row long, ps array<long>, xs array<double>, y double, w double")
    got = gm.whole_gram(df, ["chrom", "region"]).toPandas()
    assert not got.duplicated(["p", "q"]).any() and len(got) <= 12 * 13 // 2 + 14
    at = {(r.p, r.q): r.value for r in got.itertuples()}
    m = np.hstack([y[:, None], x])
    g = m.T @ (w[:, None] * m)
    assert at.pop((-2, -2)) == 89
    want = {(i - 1, j - 1): g[i, j] for i in range(13) for j in range(i, 13) if g[i, j]}
    assert at.keys() == want.keys() and all(at[k] == pytest.approx(want[k]) for k in at)
    # a block of few rows with many parameters goes out tile by tile there too
    long = df.select("chrom", "region", "row", "y", "w", F.explode(F.arrays_zip("ps", "xs")).alias("r")).select("chrom", "region", "row", "y", "w", F.col("r.ps").alias("p"), F.col("r.xs").alias("x"))
    assert {(r.p, r.q): pytest.approx(r.value) for r in gm.gram_entries(long, [], ["chrom", "region"]).collect()} == {(r.p, r.q): r.value for r in got.itertuples()}


def test_groups_whose_parameters_rarely_meet_are_multiplied_without_tiles(spark, monkeypatch):
    monkeypatch.setattr(gm, "TILE", None)  # no tile of all rows and parameters is made
    rng = np.random.default_rng(3)
    n, size = 600, 3000
    x = np.zeros((n, size))
    x[np.repeat(np.arange(n), 4), rng.integers(0, size, 4 * n)] = rng.random(4 * n) + 0.1
    x[:, 7] = rng.random(n) + 0.1  # one in all rows of both groups
    x[np.arange(n) % 2 == 1, :7] = 0  # and some of one group
    x[5, 8:600] = 1.0  # one long row
    y, w = rng.random(n) - 0.5, rng.random(n) + 0.5
    rows = [(i % 2, 1, i, [int(j) for j in np.flatnonzero(x[i])], [float(v) for v in x[i][x[i] != 0]], float(y[i]), float(w[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "chrom int, region long, row long, ps array<long>, xs array<double>, y double, w double")
    m = np.hstack([y[:, None], x])
    g = m.T @ (w[:, None] * m)
    want = {(i - 1, j - 1): g[i, j] for i, j in zip(*np.nonzero(np.triu(g)))} | {(-2, -2): n}
    for pairs in (gm.PAIRS, 300):  # 300: a parameter's products are made in several parts
        monkeypatch.setattr(gm, "PAIRS", pairs)
        got = gm.whole_gram(df, ["chrom", "region"]).toPandas()
        assert not got.duplicated(["p", "q"]).any()
        at = {(r.p, r.q): r.value for r in got.itertuples()}
        assert at.keys() == want.keys() and np.allclose([at[k] for k in want], list(want.values()), atol=1e-12)
    rounded = {(r.p, r.q): r.value for r in gm.whole_gram(df, ["chrom", "region"], 4).collect()}
    assert rounded.keys() == want.keys() and all(abs(rounded[k] - want[k]) < 5.1e-5 and rounded[k] == round(rounded[k], 4) for k in want)


def test_values_are_rounded_half_away_from_zero():
    got = gm._rounded(np.array([0.00005, -0.00005, -0.00001, 0.00004999, 1.23456, -1.23456, 1e307]), 4)
    assert got.tolist() == [0.0001, -0.0001, 0.0, 0.0, 1.2346, -1.2346, 1e307] and not np.signbit(got[2])


def test_shuffles_of_a_staged_table_go_when_it_is_written(spark):
    left = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    x = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    scratch = Scratch(spark)
    before = left()
    out = scratch.stage(x, release=True)
    for _ in range(50):  # files are removed in the background
        if left() <= before:
            break
        time.sleep(0.1)
    assert left() <= before and out.count() == 10 and spark.conf.get(RELEASE) == "false"
    scratch.stage(x)
    assert left() > before
