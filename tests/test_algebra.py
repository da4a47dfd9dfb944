import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.functions import scalars as S
from varloom.operators import folds, graph, sparse as sp


@pytest.fixture(scope="module")
def toy(spark):
    pairs = spark.createDataFrame([(1, 1, 0, 1, 0.25)], "chrom int, region long, a long, b long, r2 double")
    ids = spark.createDataFrame([(0,), (1,)], "variant_idx long")
    return sp.symmetric(pairs, ids)


def test_ld_scores_of_the_two_by_two_block(spark, toy):
    v = spark.createDataFrame([(0, 2.0), (1, 3.0)], "variant_idx long, value double")
    assert {r.row_idx: r.value for r in sp.spmv(toy, v).collect()} == {0: 2.75, 1: 3.5}
    assert {r.row_idx: r.ld_score for r in sp.ld_score(toy).collect()} == {0: 1.25, 1: 1.25}
    h = spark.createDataFrame([(0, 0.10), (1, 0.02)], "variant_idx long, value double")
    got = {r.row_idx: r.value for r in sp.spmv(toy, h).collect()}
    assert got[0] == pytest.approx(0.105) and got[1] == pytest.approx(0.045)


def test_cleaning(spark):
    rows = [(1, 2, 1, 0.5), (1, 2, 1, 0.7), (1, -1, 1, 9.0), (1, None, 1, 9.0), (None, 2, 1, 9.0), (1, 2, 2, float("nan")), (1, 2, 2, float("inf")), (1, 2, 2, -1.0), (1, 2, 3, 0.0)]
    t = spark.createDataFrame(rows, "variant_idx long, gene_idx long, mechanism_idx long, value double")
    assert sorted(tuple(r) for r in sp.clean_triples(t).collect()) == [(1, 2, 1, 0.7), (1, 2, 3, 0.0)]
    e = spark.createDataFrame([(1, 1, 5, 3, 0.2), (1, 1, 3, 5, 0.4), (1, 1, 3, 3, 1.0), (1, 1, 3, 6, float("nan")), (1, 1, 3, 7, 1.5), (1, 1, 3, 8, 0.001), (1, 1, 3, 9, None)], "chrom int, region long, row_idx long, col_idx long, r2 double")
    assert [tuple(r) for r in sp.ld_pairs(e).collect()] == [(1, 1, 3, 5, 0.4)]
    s = spark.createDataFrame([(0.05,), (0.5,)], "r double")
    assert [round(r.r2, 6) for r in sp.squared(s, "r", 0.01, 102).collect()] == [round(0.25 * 101 / 100 - 0.01, 6)]


def test_context_aggregates_and_contributions(spark):
    # two variants, two genes, two contexts: parameters (gene, context)
    cells = [(0, 0, 0, 0.2), (0, 1, 0, 0.3), (0, 1, 1, 0.4), (1, 0, 1, 0.7), (1, 1, 1, 0.5)]
    t = spark.createDataFrame(cells, "variant_idx long, gene_idx long, mechanism_idx long, value double")
    s = {(r.variant_idx, r.mechanism_idx): round(r.value, 6) for r in sp.context_scores(t).collect()}
    assert s == {(0, 0): 0.5, (0, 1): 0.4, (1, 1): 1.2}
    b = {(r.variant_idx, r.mechanism_idx): r.value for r in sp.context_scores(t, "binary").collect()}
    assert b == {(0, 0): 1, (0, 1): 1, (1, 1): 1}
    with pytest.raises(ValueError):
        sp.context_scores(t, "mean")
    masses = spark.createDataFrame([(0, 0, 2.0), (0, 1, 3.0), (1, 0, 4.0), (1, 1, 5.0)], "gene_idx long, mechanism_idx long, mass double")
    coef = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.2), (1, 0, 0.3), (1, 1, 0.4)], "gene_idx long, mechanism_idx long, coef double")
    prod = {(r.gene_idx, r.mechanism_idx): round(r.mass * r.coef, 6) for r in masses.join(coef, ["gene_idx", "mechanism_idx"]).collect()}
    assert prod == {(0, 0): 0.2, (0, 1): 0.6, (1, 0): 1.2, (1, 1): 2.0}
    cm = spark.createDataFrame([(0, 1.0), (1, 2.0)], "mechanism_idx long, annotation_count double")
    ef = spark.createDataFrame([(0, 0.5), (1, 0.25)], "mechanism_idx long, effect double")
    one = masses.withColumn("mass", F.lit(1.0))
    co = spark.createDataFrame([(0, 0, 0.4), (1, 0, 0.6), (0, 1, 1.0), (1, 1, 0.0)], "gene_idx long, mechanism_idx long, coef double")
    got = {r.mechanism_idx: (r.global_h2, r.deviation_h2, r.total_h2, r.fraction) for r in sp.context_contributions(one, co, cm, ef).collect()}
    assert got == {0: (0.5, 1.0, 1.5, 0.5), 1: (0.5, 1.0, 1.5, 0.5)}


def test_normal_equations(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, y double, w double")
    c = {(r.i, r.j): r.value for r in sp.normal_equations(df, ["a", "b"], "y", "w").collect()}
    w = x[:, 3]
    assert c[0, 1] == pytest.approx((w * x[:, 0] * x[:, 1]).sum()) and c[1, 2] == pytest.approx((w * x[:, 1] * x[:, 2]).sum())
    assert c[2, 2] == pytest.approx((w * x[:, 2] ** 2).sum()) and c[2, 3] == pytest.approx(w.sum())


def union_find(edges):
    p = {}

    def find(x):
        while p.setdefault(x, x) != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(p)}


def test_region_components_and_sweep(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(r, r * 1000 + rng.randint(0, 60), r * 1000 + rng.randint(0, 60), rng.random()) for r in range(3) for _ in range(40)] + [(9, 9000 + i, 9001 + i, 0.9) for i in range(300)]
    e = spark.createDataFrame(edges, "region long, a long, b long, r2 double")
    monkeypatch.setattr(graph, "CHUNK", 5)
    got = {r.id: r.component for r in graph.region_components(e, ["region"], "a", "b").collect()}
    assert got == union_find([(a, b) for _, a, b, _ in edges])
    sw = graph.sweep(e, [0.2, 0.8], ["region"]).collect()
    assert {r.id: r.component for r in sw if r.threshold == 0.8} == union_find([(a, b) for _, a, b, x in edges if x >= 0.8])
    s = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (1, 9)], "c int, size int")
    r = graph.size_summary(s, ["c"]).first()
    assert (r.n_components, r.n_singletons, r.largest, r.q50) == (4, 2, 9, 1.5)


def test_folds(spark):
    got = folds.greedy_folds([(1, 10, [1]), (2, 10, [1]), (3, 5, []), (4, 4, [2])], 2)
    assert got == {1: 0, 2: 1, 3: 0, 4: 1}
    with pytest.raises(ValueError):
        folds.greedy_folds([], 1)
    m = spark.createDataFrame([(v, v // 3) for v in range(30)], "variant_idx long, component long")
    l = spark.createDataFrame([(0, 1), (3, 1), (6, 2)], "variant_idx long, gene_idx long")
    f = folds.assign_folds(m, l, 5)
    sizes = m.join(f, "component").groupBy("fold").count().collect()
    assert sorted(r["count"] for r in sizes) == [6] * 5
    vf = m.join(f, "component").select("variant_idx", "fold")
    sc = {r.variant_idx: r.score_group for r in folds.score_rows(vf, l).collect()}
    fold = {r.variant_idx: r.fold for r in vf.collect()}
    assert {v for v, s in sc.items() if s >= 0} == {0, 3} and sc[0] == fold[0] and fold[0] != fold[3]
    with pytest.raises(ValueError):
        folds.assign_folds(m, l, 5, most=3)


def test_scalars(spark):
    r = spark.createDataFrame([("chr7", "chr7:99:A:G", "ENSG1.4", "abc", None, " a--b!")], "c string, v string, e string, s string, f string, t string")
    ch, pos = S.variant_id_parts("v")
    row = r.select(S.chrom_number("c"), ch, pos, S.strip_version("e"), S.match_key("e", "s"), S.match_key("s", "s"), S.keeps_self_promoter("f"), S.slug("t"), S.member("c", "chr7, x"), S.member("c", "all")).first()
    assert tuple(row) == (7, 7, 99, "ENSG1", "ENSG1", "ABC", True, "a_b", True, True)
    n = spark.createDataFrame([(34933.0, 31009.0)], "a double, b double").select(S.effective_n("a", "b")).first()[0]
    assert n == pytest.approx(4 * 34933 * 31009 / (34933 + 31009))
    z = [x[0] for x in spark.createDataFrame([(0.05,), (1.0,), (1e-320,), (None,)], "p double").select(S.p_to_z("p")).collect()]
    assert z[0] == pytest.approx(1.959964, abs=1e-6) and z[1] == 0 and 37 < z[2] < 39 and (z[3] is None or math.isnan(z[3]))
    want = sum(math.comb(5, k) * math.comb(15, 6 - k) for k in range(3, 6)) / math.comb(20, 6)
    assert S.hypergeom_sf(3, 20, 5, 6) == pytest.approx(want) and S.hypergeom_sf(0, 20, 5, 6) == 1 and S.hypergeom_sf(6, 20, 5, 6) == 0
    lab = spark.createDataFrame([(1,), (5,), (64,)], "n int").select(S.bin_label(S.log2_bin("n"))).collect()
    assert [x[0] for x in lab] == ["1", "4-7", "64-127"]
    with pytest.raises(ValueError):
        S.annotation_value("other")
