import math
import os
import random

import pytest
from pyspark.sql import functions as F

from varloom.llm.components import connected_components
from varloom.operators.graph import forest
from varloom.llm.cutoff import cutoffs, keep_fraction
from varloom.llm.splits import assign_splits, balanced_bins, broken_families, deal, families, with_untied
from varloom.llm.topn import top_n
from varloom.llm import cutoff, queries
from varloom.session import Scratch

import numpy as np

NAN, INF = float("nan"), float("inf")
DATA = "/root/testdata/sf0.001"


def test_top_n_matches_brute_force_under_skew_ties_and_repeats(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), f"i{rng.randint(0, 150)}" if rng.random() > 0.03 else None, rng.choice([0.0, -0.0, 1.0, 2.5, None, NAN, INF, -INF, rng.random()])) for _ in range(3000)]
    df = spark.createDataFrame([(g, i, s, 1, "x") for g, i, s in rows], "g string, i string, s double, rank int, _part string")
    best = {}
    for g, i, s in rows:
        if i is not None and s is not None and math.isfinite(s):
            best[g, i] = max(best.get((g, i), -INF), s)
    want = set()
    for g in {g for g, _ in best}:
        order = sorted(((-s - 0.0, i) for (h, i), s in best.items() if h == g))
        want |= {(g, r, i) for r, (_, i) in enumerate(order[:7], 1)}
    for sub in (1, 5):
        got = {(r.g, r["rank"], r["item"]) for r in top_n(df, ["g"], "i", "s", 7, sub).collect()}
        assert got == want
    assert top_n(df.limit(0), ["g"], "i", "s").count() == 0


def union_find(edges):
    p = {}

    def find(x):
        while p.setdefault(x, x) != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(p)}


def graphs():
    rng = random.Random(5)
    chain = list(range(400))
    rng.shuffle(chain)
    yield "random", [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)]
    yield "shuffled path", list(zip(chain, chain[1:]))
    yield "sorted path and star", [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(100)]
    yield "negative and repeated", [(-5, 3), (3, -5), (-5, 3), (7, 7), (8, 9), (9, 8)]
    yield "giant and dust", [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(1, 59)] + [(1000 + 2 * i, 1001 + 2 * i) for i in range(50)]


@pytest.mark.parametrize("name,edges", list(graphs()))
@pytest.mark.parametrize("chunk", [1, 1_000_000])
def test_components(spark, name, edges, chunk):
    df = spark.createDataFrame(edges + [(None, 1), (2, None)], "a long, b long")
    got = connected_components(df, "a", "b", chunk)
    rows = got.collect()
    want = union_find([e for e in edges if e[0] != e[1]])
    assert len(rows) == len(want) and {r.id: r.group_idx for r in rows} == want


@pytest.mark.parametrize("steps", [1, 2, 40])
def test_components_without_peeling_to_the_end(spark, steps):
    edges = [(i, i + 1) for i in range(60)] + [(30, 100 + i) for i in range(9)] + [(70, 71)]
    df = spark.createDataFrame(edges, "a long, b long")
    rows = connected_components(df, "a", "b", 1, thin=0.0, steps=steps).collect()
    assert len(rows) == 72 and {r.id: r.group_idx for r in rows} == union_find(edges)
    assert connected_components(df.limit(0), "a", "b").count() == 0


def test_forest():
    ids, low = forest(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert dict(zip(ids.tolist(), low.tolist())) == {1: 1, 3: 1, 5: 1, 8: 8, 9: 8}


def test_families_and_broken_folds(spark):
    t = [(5, 1, 0.1), (6, 1, None), (6, 2, NAN), (4, 2, -1.0), (9, 3, 1.0), (10, None, 1.0), (11, -1, 1.0), (None, 3, 1.0), (20, 7, 1.0)]
    tri = spark.createDataFrame(t, "variant_idx long, gene_idx long, value double")
    fam = families(tri)
    got = {(r.family_idx, r.kind, r.idx) for r in fam.collect()}
    assert got == {(4, "variant", 4), (4, "variant", 5), (4, "variant", 6), (4, "gene", 1), (4, "gene", 2), (9, "variant", 9), (9, "gene", 3), (20, "variant", 20), (20, "gene", 7)}
    f = spark.createDataFrame([(4, 1, -1), (5, None, 1), (6, 1, 2), (9, 3, -1), (9, 3, 3), (20, 1, -1), (20, 2, -1), (99, 1, 2)], "variant_idx long, cv_groups int, cv_score_groups int")
    assert {tuple(r) for r in broken_families(fam, f).collect()} == {(4, 4), (4, 5), (4, 6), (20, 20)}
    assert broken_families(fam, f.limit(0)).count() == 0 and families(tri.limit(0)).count() == 0


def test_untied_variants_and_genes_get_a_split(spark):
    t = [(5, 1), (6, 1), (6, None), (10, None), (10, -1), (11, -1), (None, 3), (-1, 3), (None, 1), (None, None), (-1, -1)]
    tri = spark.createDataFrame(t, "variant_idx long, gene_idx long")
    fam = with_untied(families(tri), tri)
    want = {(5, "variant", 5), (5, "variant", 6), (5, "gene", 1), (10, "variant", 10), (11, "variant", 11), ((1 << 62) + 3, "gene", 3)}
    assert sorted(tuple(r) for r in fam.select("family_idx", "kind", "idx").collect()) == sorted(want)
    out = assign_splits(fam, "family_idx", {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    assert len(out) == 6 and all(r.split for r in out)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_every_variant_and_gene_of_the_table_is_in_p2_splits(spark):
    out, t = queries.p2_splits(spark, DATA), spark.read.parquet(f"{DATA}/annotation_triples.parquet")
    for kind in ("variant", "gene"):
        want = {r[0] for r in t.where(f"{kind}_idx >= 0").select(f"{kind}_idx").distinct().collect()}
        assert sorted(r.idx for r in out.where(f"kind = '{kind}'").collect()) == sorted(want)


def test_balanced_bins_and_splits(spark):
    rng = random.Random(6)
    w = [(i, rng.randint(1, 50)) for i in range(1000)]
    for n, ratio in ((512, 1.05), (1000, 2.2)):
        where, last = balanced_bins(Scratch(spark, "t"), spark.createDataFrame(w[:n], "unit long, weight long"), bins=40)
        rows = where.collect()
        # ranked over range partitions, the same
        wide, _ = balanced_bins(Scratch(spark, "t"), spark.createDataFrame(w[:n], "unit long, weight long"), bins=40, one_task=0)
        assert sorted(wide.collect()) == sorted(rows)
        assert len(rows) == n and len(last) <= 40
        by = {}
        for r in rows:
            by[r.bin] = by.get(r.bin, 0) + dict(w)[r.unit]
        assert by == dict(last) and max(by.values()) <= ratio * min(by.values())
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    members = spark.createDataFrame([(i, j, "s") for i, n in w for j in range(n)] + [(None, 0, "s")], "g long, j int, _split string")
    out = assign_splits(members, "g", shares, bins=40)
    assert out.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    n = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    whole = sum(x for _, x in w)
    assert sum(n.values()) == whole and all(abs(n[s] / whole - x) < 0.02 for s, x in shares.items())
    assert assign_splits(members.limit(0), "g", shares).count() == 0
    assert deal([(1, 100), (2, 1)], shares) == {1: "train", 2: "validation"}


def brute_cut(rows, share):
    best = {}
    for s, r, x in rows:
        if r is not None and r.strip() and x is not None and math.isfinite(x):
            k = (s, r.strip().upper())
            best[k] = max(best.get(k, -INF), x)
    kept, cuts = set(), {}
    for s in {k[0] for k in best}:
        v = sorted((x for (t, _), x in best.items() if t == s), reverse=True)
        k = min(len(v), -(-len(v) * share // 1000))
        if k:
            cuts[s] = v[k - 1]
            kept |= {(t, r) for (t, r), x in best.items() if t == s and x >= v[k - 1]}
    return kept, cuts


@pytest.mark.parametrize("share", [0, 1, 333, 1000, 2000])
def test_cutoffs(spark, share, monkeypatch):
    rng = random.Random(7)
    pool = [0.0, 1e308, -1e308, 5e-324, 1.5, 1.5, 2.0, None, NAN, INF]
    rows = [(rng.choice(["hot"] * 9 + ["a", "b"]), rng.choice([None, "", " x "] + [f"G{i}" for i in range(300)]), rng.choice(pool) if rng.random() < 0.3 else rng.gauss(0, 1) * 10 ** rng.randint(-9, 9)) for _ in range(1500)]
    df = spark.createDataFrame([(s, "p", r, x) for s, r, x in rows] + [("lost", "q", "G", 1.0)], "src string, pan string, rec string, sc double")
    targets = spark.createDataFrame([("p", share)], "panel string, keep_permille int")
    want, cuts = brute_cut(rows, share)
    for limit, bins in ((100_000, 16), (0, 3)):
        monkeypatch.setattr(cutoff, "BROADCAST_ROWS", limit)
        table, kept = keep_fraction(df, targets, "src", "pan", F.upper(F.trim("rec")), "sc", bins=bins)
        assert {(r.source, r.record) for r in kept.collect()} == want
        got = {r.source: (r.cutoff, r.kept) for r in table.collect()}
        assert {s: c for s, (c, _) in got.items()} == cuts and all(n == sum(t == s for t, _ in want) for s, (_, n) in got.items())


def test_cutoffs_of_nothing(spark):
    df = spark.createDataFrame([], "src string, pan string, rec string, sc double")
    t, k = keep_fraction(df, spark.createDataFrame([("p", 5)], "panel string, keep_permille int"), "src", "pan", F.col("rec"), "sc")
    assert t.count() == 0 and k.count() == 0
    assert cutoffs is not None
