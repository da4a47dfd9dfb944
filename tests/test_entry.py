import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60
    for n in (3, 5):
        assert f"p{n}_found" in q


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["p3_found", "p3_cover", "p5_found", "p5_loaded", "cre_range_join", "peak_context_pivot", "tss_band_join", "gene_contribution_rank", "ld_components", "sldsc_normal_eq", "liftover_unique", "target_overlap_topk"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    df = entry.queries()[name](spark, DATA)
    rel = c.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    at = [rel.columns.index(x) for x in cols]
    canon = lambda r: tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(canon([r[x] for x in cols]) for r in df.collect()) == sorted(canon([r[i] for i in at]) for r in rel.fetchall())
