import os

import pytest

from varloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    df, rel = queries.QUERIES[name](spark, DATA), c.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    at = [rel.columns.index(x) for x in cols]
    canon = lambda r: tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(canon([r[x] for x in cols]) for r in df.collect()) == sorted(canon([r[i] for i in at]) for r in rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_other_queries_run(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert df.count() > 0
    if name.endswith("_found"):
        assert df.distinct().count() == df.count()


def test_found_schemas(spark):
    want = {
        "p1_found": ["source", "analysis", "rank", "ensembl"],
        "p2_found": ["family_idx", "variant_idx"],
        "p4_found": ["group_idx", "variant_idx"],
        "p6_found": ["source", "symbol"],
        "p7_ids": ["doc_id", "ids"],
        "p8_found": ["doc_id", "item_id"],
        "p9_found": ["doc_id", "segment", "lang"],
    }
    if os.path.isdir(DATA):
        assert {n: queries.QUERIES[n](spark, DATA).columns for n in want} == want
