import json

import pytest
from pyspark.sql import functions as F

from varloom.plans import prepare as pp
from varloom.sources import sinks
from varloom.stats.fit import Fit

import numpy as np


@pytest.fixture(scope="module")
def bim(spark):
    return spark.createDataFrame([("rs2", 1, 200), ("rs1", 1, 100)], "snp string, chrom int, pos long")


def test_marker_annotations(spark, bim):
    five = ["a", "b", "c", "d", "e"]
    links = spark.createDataFrame([(1, 100, 100, "G", 0.02 + 0.01 * i, c, None) for i, c in enumerate(five)], "chrom int, start long, end long, gene string, score double, cell_type string, is_self_promoter string")
    out = {r.snp: [round(r[c], 2) for c in five] for r in pp.marker_annotations(bim, links, five).collect()}
    assert out == {"rs1": [0.02, 0.03, 0.04, 0.05, 0.06]}
    two = spark.createDataFrame([(1, 100, 100, "PROMOTER", 1.0, "a", "true"), (1, 100, 100, "DISTAL", 0.02, "a", "false"), (1, 100, 100, "GENE2", 0.03, "a", "false")], links.schema)
    assert pp.marker_annotations(bim, two, ["a"], exclude_self_promoter=True).first().a == pytest.approx(0.05)
    assert pp.marker_annotations(bim, two, ["a"], binary=True).first().a == 1.0
    pos = spark.createDataFrame([(str(p), 1, p) for p in (100, 101, 150, 201, 202)], "snp string, chrom int, pos long")
    peaks = spark.createDataFrame([(1, 99, 101, "x"), (1, 149, 201, "x")], "chrom int, start long, end long, context string")
    assert {r.snp for r in pp.marker_peaks(pos, peaks, ["x"]).collect()} == {"100", "101", "150", "201"}


def test_reference_identifiers(spark):
    ref = spark.createDataFrame([(1, 100, "rs1"), (1, 200, "duplicate-a"), (1, 200, "duplicate-b")], "chrom int, pos long, snp string")
    rows = [(1, 100, "chr1:110:A:G", 2.0, 1000, 1), (1, 200, "chr1:210:C:T", 3.0, 1000, 2), (1, 100, "x", -3.0, 900, 3), (1, 100, "y", None, 1, 0), (1, 100, "z", 9.0, 0, 0), (23, 100, "w", 1.0, 5, 0)]
    g = spark.createDataFrame(rows, "chrom int, pos long, snp string, z double, n int, line int")
    assert [tuple(r) for r in pp.match_to_reference(g, ref, ["line"]).collect()] == [("rs1", 1000, 2.0)]
    own = pp.match_to_reference(g.union(spark.createDataFrame([(1, 5, "x", 7.0, 8, 9), (1, 5, None, 7.0, 8, 9)], g.schema)), None, ["line"])
    assert sorted(tuple(r) for r in own.collect()) == [("chr1:110:A:G", 1000, 2.0), ("chr1:210:C:T", 1000, 3.0), ("x", 900, -3.0)]


def test_reference_files(spark, tmp_path):
    m = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.25), (1, 0, 0.25), (1, 1, 1.0)], "row_idx long, col_idx long, r2 double")
    sc = spark.createDataFrame([(0, 1, 2.0), (1, 1, 3.0)], "variant_idx long, mechanism_idx long, value double")
    v = spark.createDataFrame([(0, 1, "rs1", 10), (1, 1, "rs2", 20)], "variant_idx long, CHR int, SNP string, BP long")
    pp.write_reference(m, sc, v, [1], str(tmp_path / "ref"))
    read = lambda n: [list(r) for r in spark.read.csv(f"{tmp_path}/ref/{n}", sep="\t", header=True).orderBy("CHR").collect()]
    assert read("m") == read("m_5_50") == [["1", "2.0", "5.0"]]
    assert [r[3:5] for r in sorted(read("reference"), key=lambda r: r[1])] == [["1.25", "2.75"], ["1.25", "3.5"]]
    assert [r[4] for r in sorted(read("annot"), key=lambda r: r[1])] == ["2.0", "3.0"] and [r[3] for r in read("weights")] == ["1.25", "1.25"]
    assert sinks.name_parts(spark, f"{tmp_path}/ref/reference", "abc.{}.l2.ldscore.gz") == ["abc.1.l2.ldscore.gz"]
    with pytest.raises(ValueError):
        pp.write_reference(m, sc, v.withColumn("SNP", F.lit("same")), [1], str(tmp_path / "bad"))


def test_lifted_links_and_expressed_genes(spark):
    blocks = spark.createDataFrame([(1, 0, 100, 1, 1000, True), (1, 200, 300, 2, 0, True)], "chrom int, start long, end long, to_chrom int, to_start long, forward boolean")
    links = spark.createDataFrame([(1, 10, 20, "G", 0.5, "cell", "True"), (1, 90, 210, "H", 0.5, "cell", "False"), (1, 150, 160, "K", 0.1, "other", None)], "chrom int, start long, end long, gene string, score double, cell_type string, is_self_promoter string")
    new, counts = pp.lift_links(links, blocks)
    assert [tuple(r) for r in new.collect()] == [(1, 1010, 1020, "G", 0.5, "cell", "True")]
    assert {r.cell_type: tuple(r)[1:] for r in counts.collect()} == {"cell": (2, 1, 1), "other": (1, 0, 1)}
    t = spark.createDataFrame([(1, 11, "G", "true", "a"), (1, 11, "G", "TRUE", "a"), (1, 12, "H", "false", "a"), (1, 0, "I", "true", "a"), (1, 150, "J", "true", "a")], "chrom int, tss long, gene string, expressed string, cell_type string")
    assert [tuple(r) for r in pp.expressed_genes(t, blocks).collect()] == [(1, 1011, "G", "a")]


def test_marker_identity(spark):
    v = spark.createDataFrame([(0, "rs1", "chr1:5", 1, 5), (1, "other", "chr1:6", 1, 6)], "variant_idx long, marker string, variant_id string, chrom int, pos long")
    meta = spark.createDataFrame([("rs1", "A", "C", "chr1:9", 1, 0), ("rs2", "A", "G", "chr1:6", 1, 1), ("rs3", "A", "T", "chr1:6", 1, 2)], "snp string, a1 string, a2 string, variant_id string, chrom int, ld_row long")
    assert sorted(tuple(r) for r in pp.snp_identity(v, meta).collect()) == [(0, "rs1", "A", "C", 1, 5), (1, "rs2", "A", "G", 1, 6)]
    with pytest.raises(ValueError):
        pp.snp_identity(v, meta.where("snp = 'rs1'"))


def test_predicted_and_reference(spark, tmp_path):
    links = spark.createDataFrame([(1, 5, "G", "m", 0.95), (1, 5, "G", "m", 0.99), (1, 7, "G", "m", 0.5)], "chrom int, pos long, gene string, mechanism string, score double")
    blocks = spark.createDataFrame([(1, 0, 10, 1, 100, True)], "chrom int, start long, end long, to_chrom int, to_start long, forward boolean")
    assert [tuple(r) for r in pp.prepare_predicted(links, blocks, 0.9).collect()] == [(1, 105, "G", "m", 0.99)]
    m = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0), (0, 1, 0.25), (1, 0, 0.25)], "row_idx long, col_idx long, r2 double")
    s = spark.createDataFrame([(0, 1, 2.0), (1, 1, 3.0)], "variant_idx long, mechanism_idx long, value double")
    mk = spark.createDataFrame([(0, 1, "rs1", 5), (1, 1, "rs2", 6)], "variant_idx long, CHR int, SNP string, BP long")
    pp.write_reference(m, s, mk, [1], str(tmp_path / "ref"))
    got = spark.read.csv(str(tmp_path / "ref/reference"), sep="\t", header=True).orderBy("BP").collect()
    assert [(r.SNP, float(r.base), float(r.L1)) for r in got] == [("rs1", 1.25, 2.75), ("rs2", 1.25, 3.5)]


def test_coefficient_tables(spark, tmp_path):
    coef = spark.createDataFrame([(1, 0, 0.5)], "gene_idx long, mechanism_idx long, coef double")
    genes = spark.createDataFrame([(1,), (2,)], "gene_idx long")
    assert sorted(tuple(r) for r in pp.reindex_coefficients(coef, genes, [0, 1]).collect()) == [(1, 0, 0.5), (1, 1, 0.0), (2, 0, 0.0), (2, 1, 0.0)]
    with pytest.raises(ValueError):
        pp.reindex_coefficients(coef, genes, [1])
    path = tmp_path / "e.tsv"
    path.write_text("context\teffect\tstandard_error\nb\t0.2\t0.1\na\t0\t0.3\n")
    assert pp.read_context_effects(spark, str(path), ["a", "b"]) == [("a", 0.0, 0.3), ("b", 0.2, 0.1)]
    with pytest.raises(ValueError):
        pp.read_context_effects(spark, str(path), ["a"])
    path.write_text("context\teffect\na\t-1\n")
    with pytest.raises(ValueError):
        pp.read_context_effects(spark, str(path), ["a"])
    fit = Fit("hierarchical", np.ones((1, 2)), 0.1, np.array([0.5, 0.2]), np.array([0.1, np.nan]), [1.0])
    pp.write_fit(spark, str(tmp_path / "fit"), fit, ["g"], ["a", "b"], {"best_lambda": 1.0})
    assert json.load(open(tmp_path / "fit/metadata.json"))["best_lambda"] == 1.0 and spark.read.parquet(str(tmp_path / "fit/coefficients")).count() == 2
    assert sinks.json_safe(np.array([np.inf])) == [None]


def test_enrichment(spark):
    r = spark.range(1000).select(F.lit("s").alias("g"), F.col("id").cast("string").alias("ensembl"), (F.col("id") + 1).alias("rank"))
    sets = r.where("rank <= 20").select(F.lit("top").alias("set_name"), "ensembl").union(r.where("rank % 50 = 0").select(F.lit("even"), "ensembl"))
    out = pp.enrich(r, r.where("rank <= 100"), sets, ["g"]).collect()
    assert [(x.set_name, x.hits, x.n_set, x.n_top) for x in out] == [("top", 20, 20, 100)] and out[0].p < 1e-15
