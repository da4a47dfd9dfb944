import random

import pytest
from pyspark.sql import functions as F

from varloom.operators.index import dense_index
from varloom.operators.joins import align_global, align_row, antijoin_identity, assert_unique, band_join, first_per, left_fill, range_join, range_max, unique_keys
from varloom.operators.liftover import chain_blocks, lift


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    pts = [(i, rng.choice([1, 2, None]), rng.randint(0, 3000)) for i in range(300)]
    iv = [(rng.choice([1, 2]), s := rng.randint(0, 3000), s + rng.choice([-1, 0, 3, 50, 2500]), j) for j in range(120)]
    return pts, iv, spark.createDataFrame(pts, "id int, chrom int, pos long"), spark.createDataFrame(iv, "chrom int, start long, end long, j int")


@pytest.mark.parametrize("half", [False, True])
def test_range_join(data, half):
    pts, iv, p, i = data
    want = sorted((a, j) for a, c, x in pts for d, s, e, j in iv if c == d and s <= x and (x < e if half else x <= e))
    for width in (8, 1024):
        got = sorted((r.id, r.j) for r in range_join(p, i, ["chrom"], "pos", "start", "end", width, half_open=half).collect())
        assert got == want
        semi = sorted(r.id for r in range_join(p, i, ["chrom"], "pos", "start", "end", width, "left_semi", half).collect())
        assert semi == sorted({a for a, _ in want})


def test_semi_keeps_repeated_points(spark):
    p = spark.createDataFrame([(1, 5), (1, 5), (1, 99)], "chrom int, pos long")
    i = spark.createDataFrame([(1, 0, 9000), (1, 4, 6)], "chrom int, start long, end long")
    assert sorted(r.pos for r in range_join(p, i, ["chrom"], "pos", "start", "end", 16, "left_semi").collect()) == [5, 5, 99]


def test_band_join(data, spark):
    pts, iv, p, _ = data
    t = spark.createDataFrame([(c, s, j) for c, s, _, j in iv], "chrom int, tss long, j int")
    want = sorted((a, j) for a, c, x in pts for d, s, _, j in iv if c == d and abs(x - s) <= 40)
    assert sorted((r.id, r.j) for r in band_join(p, t, ["chrom"], "pos", "tss", 40).collect()) == want


def test_key_helpers(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", None, "z"), (None, 1, "w")], "k string, o int, v string")
    assert {(r.k, r.v) for r in first_per(df, ["k"], [F.col("o"), F.col("v")]).collect()} == {("a", "y"), ("b", "z"), (None, "w")}
    assert {r.k for r in unique_keys(df, ["k"]).collect()} == {"b", None}
    with pytest.raises(ValueError):
        assert_unique(df, ["k"])
    left = spark.createDataFrame([("a",), ("c",)], "k string")
    filled = left_fill(left, unique_keys(df, ["k"]).drop("v"), ["k"], {"o": 0})
    assert sorted((r.k, r.o) for r in filled.collect()) == [("a", 0), ("c", 0)]


def test_alignment(spark):
    left = spark.createDataFrame([("m1", "v1"), ("m2", "v2"), (None, "v3")], "m string, v string")
    right = spark.createDataFrame([("zz", "v1", 1.0, 1), ("zz", "v2", 2.0, 2), ("m3", "v3", 3.0, 3)], "snp string, vid string, z double, o int")
    out, key = align_global(left, right, [("m", "snp"), ("v", "vid")], [F.col("o")])
    assert key == "v" and out.count() == 3
    with pytest.raises(ValueError):
        align_global(left, right.limit(0), [("m", "snp")], [F.col("o")])
    look = spark.createDataFrame([("m1", "q", 5, 1), ("m1", "q", 6, 2), ("n", "v2", 7, 1)], "snp string, vid string, x int, o int")
    got = {r.v: r.x for r in align_row(left, look, [("m", "snp"), ("v", "vid")], "x", [F.col("o")]).collect()}
    assert got == {"v1": 6, "v2": 7, "v3": None}


def test_identity_and_index(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (1, 1, 1.0)], "row_idx long, col_idx long, r2 double")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "i long")
    assert sorted((r.row_idx, r.col_idx) for r in antijoin_identity(e, ids).collect()) == [(1, 1), (1, 2), (2, 2), (3, 3)]
    x = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"))
    assert all(r.v == r.i for r in dense_index(x, [F.col("v")], "i").collect())
    assert dense_index(x.limit(0), [F.col("v")], "i").count() == 0


def test_liftover(spark):
    text = "chain 1 chr1 1000 + 100 160 chr1 2000 + 500 565 1\n30 10 15\n20\n\nchain 2 chr2 1000 + 0 10 chr2 100 - 20 30 2\n10\n"
    blocks = chain_blocks(text)
    assert blocks == [("chr1", 100, 130, "chr1", 500, True), ("chr1", 140, 160, "chr1", 545, True), ("chr2", 0, 10, "chr2", 70, False)]
    b = spark.createDataFrame(blocks, "chrom string, start long, end long, to_chrom string, to_start long, forward boolean")
    p = spark.createDataFrame([(1, "chr1", 100), (2, "chr1", 135), (3, "chr1", 150), (4, "chr2", 0), (5, "chr2", 9)], "id int, chrom string, pos long")
    assert sorted((r.id, r.to_pos) for r in lift(p, b, "id").collect()) == [(1, 500), (3, 555), (4, 79), (5, 70)]


def test_semi_join_of_many_levels_keeps_copies(spark):
    pts = spark.createDataFrame([(1, 5, {"a": 1}), (1, 5, {"a": 1}), (1, 50_000, {"a": 2}), (1, 999, {"a": 3}), (2, 5, {"a": 4}), (None, 5, {"a": 5})], "c int, pos long, m map<string,int>")
    iv = spark.createDataFrame([(1, 4, 6), (1, 0, 20_000), (1, 40_000, 500_000), (1, 40_000, 50_000)], "c int, start long, end long")
    out = range_join(pts, iv, ["c"], "pos", "start", "end", width=8, how="left_semi")
    assert out.columns == ["c", "pos", "m"] and sorted((r.c, r.pos, r.m["a"]) for r in out.collect()) == [(1, 5, 1), (1, 5, 1), (1, 999, 3), (1, 50_000, 2)]


def test_running_sum_over_partitions(spark):
    import random

    from varloom.operators.index import running_sum

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), i, rng.randint(0, 9)) for i in range(300)]
    got = {(r.g, r.i): r.run for r in running_sum(spark.createDataFrame(rows, "g string, i int, v long").repartition(5), ["g"], [F.col("i")], "v", "run").collect()}
    held = {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        held[g] = held.get(g, 0) + v
        assert got[g, i] == held[g]


def test_range_max(spark):
    rng = random.Random(5)
    pts = [(i % 90, rng.choice([1, 2, None]), rng.randint(-50, 600)) for i in range(200)]
    iv = [(rng.choice([1, 2]), s := rng.randint(-60, 600), s + rng.choice([-1, 0, 3, 50, 900]), rng.choice(["a", "b", None]), rng.choice([0.1, 0.2, 0.3])) for _ in range(150)]
    p, i = spark.createDataFrame(pts, "id int, chrom int, pos long"), spark.createDataFrame(iv, "chrom int, start long, end long, g string, v double")
    held = lambda c, x: {g: max(v for d, s, e, h, v in iv if d == c and s <= x <= e and h == g) for d, s, e, g, _ in iv if d == c and s <= x <= e}
    key = lambda r: (r[0], r[1], r[2] or "", r[3])
    want = sorted(((n, x, g, v) for n, c, x in pts for g, v in held(c, x).items()), key=key)
    for width in (8, 4096):
        got = range_max(p, i, ["chrom"], "pos", "start", "end", ["g"], "v", width=width)
        assert sorted(((r.id, r.pos, r.g, r.v) for r in got.collect()), key=key) == want
    assert range_max(p, i.limit(0), ["chrom"], "pos", "start", "end", ["g"], "v").count() == 0


@pytest.mark.parametrize("name", ["cre_triples_max", "cre_intercept_union", "tss_band_join"])
def test_hits_of_unique_identifiers_are_not_shuffled(spark, tmp_path, name):
    from varloom.plans import annotation

    d = "/root/testdata/sf0.001"
    plan = annotation.QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(event_id" not in plan
    for t in ("events", "lineitem", "orders", "part"):
        x = spark.read.parquet(f"{d}/{t}.parquet")
        (x.union(x) if t == "events" else x).write.parquet(f"{tmp_path}/{t}.parquet")
    rows = lambda at: sorted(map(tuple, annotation.QUERIES[name](spark, at).collect()))
    assert rows(str(tmp_path)) == rows(d)  # copies of an identifier count once
