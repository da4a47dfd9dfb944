import random

from pyspark.sql import functions as F

from varloom.operators.intervals import autosome, merge_periods, periods_and_gaps, running_max


def brute(rows):
    by = {}
    for k, s, e in rows:
        if s is not None and e is not None and s < e:
            by.setdefault(k, []).append((s, e))
    out = set()
    for k, iv in by.items():
        iv.sort()
        runs = []
        for s, e in iv:
            if runs and s <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], e)
            else:
                runs.append([s, e])
        out |= {(k, "period", a, b) for a, b in runs} | {(k, "gap", a[1], b[0]) for a, b in zip(runs, runs[1:])}
    return out


def run(spark, rows, tile):
    df = spark.createDataFrame(rows, "k string, s long, e long")
    return [tuple(r) for r in periods_and_gaps(df, ["k"], "s", "e", ["k"], tile).collect()]


def test_random_intervals_match_brute_force_for_any_tile(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), s := rng.randint(-50, 400), s + rng.randint(-2, 30) * rng.choice([1, 1, 1, 10])) for _ in range(400)]
    for tile in (1, 7, 64, 1 << 20):
        got = run(spark, rows, tile)
        assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_touching_nested_repeated_and_spanning(spark):
    rows = [("x", 0, 10), ("x", 10, 12), ("x", 2, 3), ("x", 0, 10), ("x", 20, 500), ("x", 30, 40), ("x", 499, 501), ("x", 600, 601), ("x", 5, 5), ("x", None, 3)]
    assert set(run(spark, rows, 16)) == {("x", "period", 0, 12), ("x", "gap", 12, 20), ("x", "period", 20, 501), ("x", "gap", 501, 600), ("x", "period", 600, 601)}


def test_empty_and_clashing_columns(spark):
    assert run(spark, [], 8) == []
    df = spark.createDataFrame([(1, 5, "p", "q", 3)], "k int, tile int, kind string, label string, e int")
    got = merge_periods(df, ["kind", "label"], "k", "tile", ["kind", "label2"]).collect()
    assert [tuple(r) for r in got] == [("p", "q", 1, 5)]


def test_autosome(spark):
    names = ["1", "chr22", "CHR9", "chr0", "chr01", "X", "23", " 1", None, ""]
    got = spark.createDataFrame([(n,) for n in names], "c string").select(autosome(F.col("c"))).collect()
    assert [r[0] for r in got] == [1, 22, 9, None, None, None, None, None, None, None]


def test_running_max(spark):
    rng = random.Random(8)
    rows = sorted({(rng.choice([1, 2]), s := rng.randint(-20, 200), s + rng.randint(0, 60)) for _ in range(200)})
    df = spark.createDataFrame(rows, "c int, s long, e long")
    want, far = {}, {}
    for c, s, e in rows:
        far[c] = max(far.get(c, -99), e)
        want[c, s, e] = far[c]
    for tile in (1, 16, 1 << 20):
        assert {(r.c, r.s, r.e): r.reach for r in running_max(df, ["c"], "s", "e", "reach", tile).collect()} == want
