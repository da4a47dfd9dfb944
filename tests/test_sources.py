import gzip
import json
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.plans import annotate as an
from varloom.sources import gwas, sinks, tables
from varloom.streaming.annotate import annotate_stream, stream_points


def put(path, text):
    if str(path).endswith(".gz"):
        with gzip.open(path, "wt") as f:
            f.write(text)
    else:
        path.write_text(text)
    return str(path)


def test_gwas_scan(spark, tmp_path):
    p = put(tmp_path / "a.tsv.gz", "CHR\tBP\tSNP\tBETA\tSE\tN\nchr1\t100\trs1\t.2\t.1\t1000\n1\t200\trs2\t.3\t0\t1000\nX\t5\trs3\t.1\tbad\t1\n")
    r = gwas.read_gwas(spark, p).collect()
    assert [(x.chrom, x.pos, x.variant_id, x.snp, round(x.z, 6), round(x.chisq, 6), x.n) for x in r] == [(1, 100, "chr1:100", "rs1", 2.0, 4.0, 1000.0)]
    q = put(tmp_path / "b.csv", "chromosome,position,pval\n2,5,0.05\n2,6,\n")
    (x,) = gwas.read_gwas(spark, q).collect()
    assert x.z == pytest.approx(1.959964, abs=1e-5) and x.n is None and x.snp is None
    w = put(tmp_path / "c.txt", "chrom  pos Z\n 3  7   -2\n")
    assert gwas.read_gwas(spark, w, "whitespace").first().chisq == 4
    with pytest.raises(ValueError):
        gwas.read_gwas(spark, put(tmp_path / "d.tsv", "chrom\tpos\n1\t2\n"))


def test_layouts(spark, tmp_path):
    p = put(tmp_path / "x.tsv", "c\tp\ts\ta\tb\tor\tse\tpv\tca\tco\nchr1\t100\trs1\ta\tg\t2.0\t.1\t.5\t34933\t31009\n1\t5\trs2\ta\tg\t-1\t.1\t.5\t1\t1\n1\t6\trs3\ta\tg\t1\t0\t.5\t1\t1\nX\t7\trs4\ta\tg\t1\t.1\t.5\t1\t1\n")
    out = gwas.apply_layout(gwas.read_delimited(spark, p), gwas.Layout("c", "p", "s", "a", "b", "se", "pv", odds_ratio="or", cases="ca", controls="co")).collect()
    assert len(out) == 1 and out[0].beta == pytest.approx(np.log(2)) and out[0].n == pytest.approx(4 * 34933 * 31009 / (34933 + 31009)) and out[0].a1 == "A"


def test_studies(spark, tmp_path):
    p = put(tmp_path / "pd.txt", "chromosome base_pair_position SNP_ID effect_allele other_allele effect_allele_frequency n_datasets p_value beta standard_error p_value(random) beta(random) I\n1 100 rs1 A G 0.2 10 0.1 0.25 0.05 0.1 0.25 0\n")
    blocks = spark.createDataFrame([(1, 0, 1000, 1, 10, True)], "chrom int, start long, end long, to_chrom int, to_start long, forward boolean")
    n = 4 * 34933 * 31009 / (34933 + 31009)
    m = gwas.prepare_study(gwas.read_delimited(spark, p, "whitespace"), gwas.layout("pd", n), str(tmp_path / "pd"), blocks)
    (r,) = spark.read.csv(str(tmp_path / "pd/table"), sep="\t", header=True).collect()
    assert (r.CHR, r.BP, r.SNP) == ("1", "110", "rs1") and float(r.N) == pytest.approx(n) and m["output_records"] == 1 and m["unmapped_records"] == 0 and m["sample_size_source"] == "study"
    x = spark.createDataFrame([("chr1", "5", "", "v1", "a", "g", "0.1", "0.2", "10", "4", "6"), ("X", "5", "r", "v", "a", "g", "0.1", "0.2", "10", "4", "6")], "chromosome string, base_pair_location string, rs_id string, variant_id string, effect_allele string, other_allele string, beta string, standard_error string, Neff_total string, N_cases string, N_controls string")
    (r,) = gwas.apply_layout(x, gwas.layout("exchange")).collect()
    assert (r.snp, r.n, r.n_cases, r.n_controls) == ("v1", 10, 4, 6)
    with pytest.raises(ValueError):
        gwas.prepare_study(x.where("chromosome = 'X'"), gwas.layout("exchange"), str(tmp_path / "none"))
    with pytest.raises(ValueError):
        gwas.apply_layout(x.drop("beta"), gwas.layout("exchange"))


def test_fold_cache(spark, tmp_path):
    f = spark.createDataFrame([(0, 0, 0), (1, 1, -1), (2, 2, 2), (3, 0, 0)], "variant_idx long, cv_groups int, cv_score_groups int")
    c = sinks.FoldCache(str(tmp_path / "arrays"), 10, 0.01)
    assert c.files.folder.endswith("arrays.cv10.r2ge0.01") and c.get(spark, 4) is None
    c.put(f, {"a": 1})
    got, meta = sinks.FoldCache(str(tmp_path / "arrays"), 10, 0.01).get(spark, 4)
    assert sorted(got.collect()) == sorted(f.collect()) and meta == {"a": 1} and c.get(spark, 5) is None
    c.files.write("metadata.json", b"{not json")
    assert c.get(spark, 4) is None


def test_interval_gene_marker_and_link_tables(spark, tmp_path):
    bed = tables.read_bed(spark, put(tmp_path / "a.bed", "chr1\t99\t101\tx\nchr1\t149\t201\nchrX\t1\t2\nchr1\t5\t5\nchr1\tq\t9\nchr2\n"))
    assert sorted(tuple(r) for r in bed.collect()) == [(1, 99, 101), (1, 149, 201)]
    with pytest.raises(ValueError):
        tables.read_bed(spark, put(tmp_path / "e.bed", "chrX\t1\t2\n"), required=True)
    t = put(tmp_path / "tss.tsv", "chrom\ttss\tgene\tCellType\nchr1\t5\tG\ta\nchr1\t5\tG\ta\nchr1\t0\tH\ta\n")
    assert tables.read_tss(spark, t, ["a"]).count() == 1
    with pytest.raises(ValueError):
        tables.read_tss(spark, t, ["a", "b"])
    bim = tables.read_bim(spark, put(tmp_path / "b.bim", "1 rs2 0 200 A G\n1 rs1 0 100 A G\n"))
    assert [(r.bim_row, r.snp) for r in bim.orderBy("bim_row").collect()] == [(0, "rs2"), (1, "rs1")]
    with pytest.raises(ValueError):
        tables.read_bim(spark, put(tmp_path / "c.bim", "1 rs2 0 200 A G\n1 rs2 0 100 A G\n"))
    g = tables.read_gtf_symbols(spark, put(tmp_path / "g.gtf", '#x\n1\ts\tgene\t1\t2\t.\t+\t.\tgene_id "E1.5"; gene_name "AB";\n1\ts\tgene\t1\t2\t.\t+\t.\tgene_id "E2.1";\n1\ts\texon\t1\t2\t.\t+\t.\tgene_id "E3";\n'))
    assert {r.ensembl: r.symbol for r in g.collect()} == {"E1": "AB", "E2": "E2"}
    j = put(tmp_path / "t.json", json.dumps({"items": [{"ensembl_gene_id": "E1.2", "hgnc_symbol": "A", "total_nominations": 2}, {"ensembl_gene_id": "E1", "hgnc_symbol": "B", "total_nominations": 1}]}))
    assert [tuple(r) for r in tables.read_targets(spark, j).collect()] == [("E1", "A", 2)]
    m = tables.read_ld_metadata(spark, put(tmp_path / "m.gz", "rsid chromosome position allele1 allele2\nrs1 1 5 A C\nrs2 1 6 A C\n"))
    assert sorted((r.ld_row, r.variant_id) for r in m.collect()) == [(0, "chr1:5"), (1, "chr1:6")]
    np.savez(tmp_path / "blk.npz", indptr=np.array([0, 2, 3]), indices=np.array([0, 1, 1]), data=np.array([1.0, 0.5, 1.0], dtype=np.float32))
    e = tables.read_npz_edges(spark, str(tmp_path / "blk.npz"))
    assert sorted((r.block, r.row_idx, r.col_idx, r.r) for r in e.collect()) == [("blk", 0, 0, 1.0), ("blk", 0, 1, 0.5), ("blk", 1, 1, 1.0)]
    a = put(tmp_path / "L.tsv", "chr\tstart\tend\tTargetGene\tABC.Score\tCellType\tisSelfPromoter\nchr1\t1\t9\tG\t.5\tz\tTrue\n")
    assert [(r.cell_type, r.is_self_promoter) for r in tables.compact_links(spark, {"cell": a}).collect()] == [("cell", "True")]


def test_annotation_sets(spark, tmp_path):
    g = spark.createDataFrame([(1, 100, "rs1"), (1, 150, "rs2"), (1, 300000, "rs3")], "chrom int, pos long, snp string")
    links = spark.createDataFrame([(1, 100, 100, "GENE1", 0.02, "a", "false"), (1, 100, 100, "GENE1", 0.03, "a", "false"), (1, 100, 100, "P", 1.0, "a", "true"), (1, 900, 901, "FAR", 0.5, "b", None), (1, 100, 150, "LOW", 0.01, "a", None)], "chrom int, start long, end long, gene string, score double, cell_type string, is_self_promoter string")
    a = an.from_links(links, g, exclude_self_promoter=True)
    assert a.mechanisms == ["intercept", "a", "b"] and a.variants.count() == 3
    genes = {r.gene_idx: r.gene for r in a.genes.collect()}
    assert set(genes.values()) == {"GENE1", "FAR"}
    assert sorted((r.variant_idx, genes[r.gene_idx], r.mechanism_idx, r.value) for r in a.triples.collect()) == [(0, "GENE1", 0, 1.0), (0, "GENE1", 1, 0.03)]
    with pytest.raises(ValueError):
        an.from_links(links.where("gene = 'FAR'"), g)
    peaks = spark.createDataFrame([(1, 99, 151, "microglia")], "chrom int, start long, end long, context string")
    tss = spark.createDataFrame([(1, 200151, "FAR", "microglia"), (1, 100, "EXPRESSED", "microglia"), (1, 100, "OTHER_CONTEXT", "astrocyte")], "chrom int, tss long, gene string, context string")
    b = an.from_peaks_and_genes(peaks, tss, g, ["microglia"])
    names = {r.gene_idx: r.gene for r in b.genes.collect()}
    assert {(r.variant_idx, names[r.gene_idx]) for r in b.triples.collect()} == {(0, "EXPRESSED"), (1, "EXPRESSED")} and "FAR" in names.values()
    two = spark.createDataFrame([(1, 90, 110, "astrocyte"), (1, 190, 210, "microglia")], "chrom int, start long, end long, context string")
    v = spark.createDataFrame([(0, 1, 100), (1, 1, 200), (2, 1, 300)], "variant_idx long, chrom int, pos long")
    assert [tuple(r)[1:] for r in an.peak_contexts(v, two, ["astrocyte", "microglia"]).orderBy("variant_idx").collect()] == [(1, 1, 0), (1, 0, 1), (0, 0, 0)]
    pred = spark.createDataFrame([(1, 100, "ENSG1", "astro", 0.95), (1, 100, "ENSG2", "astro", 0.91), (1, 200, "ENSG1", "micro", 0.99), (1, 200, "ENSG3", "micro", 0.89)], "chrom short, pos long, gene string, mechanism string, score float")
    g2 = spark.createDataFrame([(1, 100, "x"), (1, 200, "y"), (1, 300, "z")], "chrom int, pos long, snp string")
    c = an.from_predicted(pred, g2, ["astro", "micro"])
    assert c.triples.where("mechanism_idx = 0").count() == 3 and c.triples.where("mechanism_idx > 0").count() == 3 and c.genes.count() == 2 and c.variants.count() == 3
    s = {(r.variant_idx, r.mechanism_idx): round(r.v, 2) for r in c.triples.groupBy("variant_idx", "mechanism_idx").agg(F.sum("value").alias("v")).collect()}
    assert s[0, 1] == 1.86 and s[1, 2] == 0.99
    sinks.write_links(pred, str(tmp_path / "pred"))
    assert tables.read_predicted(spark, str(tmp_path / "pred"), 1, 0.9).count() == 3 and tables.read_predicted(spark, str(tmp_path / "none"), 1, 0.9).count() == 0
    assoc = spark.createDataFrame([("G1", 1, 5, "m", 0.1, 3.0, 0.01, "a"), ("G2", 1, 6, "n", 0.1, 1.0, 0.5, "a")], "gene string, chrom int, pos long, marker string, beta double, z double, p double, context string")
    d = an.from_associations(assoc, ["a"], max_genes=1)
    assert d.genes.count() == 1 and d.triples.where("mechanism_idx = 1").first().value == 9.0 and d.variants.count() == 1


def test_sinks(spark, tmp_path):
    bim = spark.createDataFrame([(1, "rs2", 0.0, 200, "A", "G", 0), (1, "rs1", 0.0, 100, "A", "G", 1)], "chrom int, snp string, cm double, pos long, a1 string, a2 string, bim_row long")
    sc = spark.createDataFrame([("rs1", 0.5)], "snp string, a double")
    sinks.write_annotations(bim, sc, ["a"], str(tmp_path / "annot"))
    (f,) = list((tmp_path / "annot" / "part=1").glob("*.gz"))
    assert gzip.open(f, "rt").read().splitlines() == ["CHR\tBP\tSNP\tCM\ta", "1\t200\trs2\t0.0\t0.0", "1\t100\trs1\t0.0\t0.5"]
    ld = spark.createDataFrame([(1, "rs1", 100, 2.75), (1, "rs2", 200, 3.5)], "CHR int, SNP string, BP long, L2 double")
    sinks.write_sumstats(ld.select("SNP", F.lit("A").alias("A1"), F.lit("C").alias("A2"), F.lit(5).alias("N"), F.col("L2").alias("Z")), str(tmp_path / "ss"), True)
    assert spark.read.csv(str(tmp_path / "ss"), sep="\t", header=True).columns == ["SNP", "A1", "A2", "N", "Z"]
    sinks.write_json(str(tmp_path / "m.json"), {"a": float("nan"), 2: np.int64(3)})
    assert json.load(open(tmp_path / "m.json")) == {"2": 3, "a": None} and not os.path.exists(tmp_path / "m.json.part")
    assert sinks.manifest(ld, ["BP"]) == {"n": 2, "min_BP": 100, "max_BP": 200}
    c = sinks.TableCache(str(tmp_path), n=5, files=["a"])
    assert c.get(spark, "x") is None
    c.put("x", ld)
    assert sinks.TableCache(str(tmp_path), files=["a"], n=5).get(spark, "x").count() == 2 and sinks.TableCache(str(tmp_path), files=["a"], n=6).get(spark, "x") is None


def test_stream(spark, tmp_path):
    iv = spark.createDataFrame([(1, 5, 9, "g")], "chrom int, start long, end long, gene string")
    for i, pos in enumerate((5, 9, 10)):
        spark.createDataFrame([(1, pos)], "chrom int, pos long").write.mode("append").parquet(str(tmp_path / "in"))
        q = annotate_stream(stream_points(spark, str(tmp_path / "in"), "chrom int, pos long"), iv, str(tmp_path / "out"), str(tmp_path / "chk"))
        q.awaitTermination()
    assert sorted(r.pos for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [5, 9]


def test_results_of_runs(spark, tmp_path):
    from varloom.sources.results import name_values, read_coefficients, read_context_effects, read_metadata

    b = put(tmp_path / "b.tsv", "gene\ta\tb\nG\t1\t0.5\n")
    assert sorted(tuple(r) for r in read_coefficients(spark, b, ["a", "b"]).collect()) == [("G", "a", 1.0), ("G", "b", 0.5)]
    with pytest.raises(ValueError):
        read_coefficients(spark, b, ["b", "a"])
    for bad in ("context\teffect\na\t1\n", "context\teffect\na\t1\na\t2\n", "context\teffect\na\t1\nb\t-2\n", "context\teffect\na\t1\nb\t2\nc\t3\n"):
        with pytest.raises(ValueError):
            read_context_effects(spark, put(tmp_path / "e.tsv", bad), ["a", "b"])
    for n in (1, 2):
        (tmp_path / f"r{n}").mkdir()
        put(tmp_path / f"r{n}" / "x.metadata.json", json.dumps({"trait": n}))
    assert sorted(r.trait for r in read_metadata(spark, str(tmp_path / "*" / "*.metadata.json")).collect()) == [1, 2]
    assert name_values(["a=1", "b=x=y"]) == {"a": "1", "b": "x=y"}
    for bad in (["a"], ["=1"], ["a="], ["a=1", "a=2"]):
        with pytest.raises(ValueError):
            name_values(bad)


def test_hits_of_loaders_are_not_shuffled(spark, monkeypatch):
    import random

    rng = random.Random(4)
    g = spark.createDataFrame([(1 + i % 2, 40 * i, f"rs{i}") for i in range(60)], "chrom int, pos long, snp string")
    spans = [(1 + rng.randrange(2), s := rng.randrange(2400), s + rng.randrange(300), rng.choice("GHI"), rng.random(), rng.choice("ab")) for _ in range(60)]
    links = spark.createDataFrame([(*x, None) for x in spans], "chrom int, start long, end long, gene string, score double, cell_type string, is_self_promoter string")
    peaks = spark.createDataFrame([(x[0], x[1], x[2], x[5]) for x in spans[:12]], "chrom int, start long, end long, context string")
    starts = [(1 + i % 2, rng.randrange(2400), rng.choice("GHI"), rng.choice("abc")) for i in range(20)]
    tss = spark.createDataFrame(starts, "chrom int, tss long, gene string, context string")
    at = {(c, p): i for i, (c, p) in enumerate(sorted((1 + i % 2, 40 * i) for i in range(60)))}
    for many in (100, 1):  # genes' numbers broadcast, or joined
        monkeypatch.setattr(an, "MOST_GENES", many)
        monkeypatch.setattr(an, "FIRST_LINKS", many)
        a, b = an.from_links(links, g), an.from_peaks_and_genes(peaks, tss, g, ["a", "b"], 150)
        want = [{}, {}]
        for (c, p), v in at.items():
            for chrom, s, e, gene, score, cell in spans:
                if chrom == c and s <= p <= e and score >= 0.015:
                    k = (v, "GHI".index(gene), "ab".index(cell) + 1)
                    want[0][k], want[0][k[0], k[1], 0] = max(score, want[0].get(k, 0)), 1.0
            for m in "ab":
                if any(x[0] == c and x[1] <= p <= x[2] and x[5] == m for x in spans[:12]):
                    for chrom, t, gene, context in starts:
                        if chrom == c and context == m and abs(t - p) <= 150:
                            want[1][v, "GHI".index(gene), "ab".index(m) + 1] = want[1][v, "GHI".index(gene), 0] = 1.0
        for x, w in zip((a, b), want):
            rows = x.triples.collect()
            assert len(rows) == len(w) and {(r.variant_idx, r.gene_idx, r.mechanism_idx): r.value for r in rows} == w
            assert not re.search(r"hashpartitioning\(variant_idx#\d+L?, gene_idx", x.triples._jdf.queryExecution().executedPlan().toString())
