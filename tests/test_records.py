from hypothesis import given, settings, strategies as st

from varloom.sources.records import is_data, parse_files, parse_records, read_row, read_text


def reason(line, feed="peaks"):
    p = read_row(line, feed)
    return None if p is None else p.fault.reason if p.fault else "ok"


def test_rows():
    good = "chr1\t5\t9\tname\t1.5"
    assert reason(good) == "ok" and reason(good + "\r") == "ok" and reason(good + "\r\r") == "value"
    assert read_row('"chr1"\t5\t"9"\t"a ""b""\tc\nd"\t.', "peaks").values == {"chrom": 1, "start": 5, "end": 9, "name": 'a "b"\tc\nd', "score": None}
    for line in (None, "", "  \t ", "\r", "# x", "track a", "browser b"):
        assert reason(line) is None
    assert reason('chr1\t5\t9\t"name\t1') == "quoting"
    assert reason('chr1\t5\t9\t"na"me\t1') == "quoting"
    assert reason('chr1\t5\t9\tna"me\t1') == "quoting"
    assert reason('x\t"y" \t3') == "quoting"
    assert reason("chr1\t5\t9\tname") == "columns" and reason("chr1 5 9 name 1") == "columns"
    for bad in ("chr01\t5\t9\tn\t1", "chr23\t5\t9\tn\t1", "chr1\t9\t9\tn\t1", "chr1\t-1\t9\tn\t1", "chr1\t5\t250000001\tn\t1", "chr1\t5\t9\tn\t1.", "chr1\t5\t9\tn\t..", "chr1\t5\t9\tn\t", "chr1\t٥\t9\tn\t1"):
        assert reason(bad) == "value", bad
    assert reason("1\t5\t250000000\t\t7") == "ok"
    assert reason("1\t5\t6\t9223372036854775807", "lifted") == "ok" and reason("1\t5\t6\t9223372036854775808", "lifted") == "value"
    assert reason("1\t000000000000000005\t6\t0", "lifted") == "ok"
    assert reason("1\t5\t6\t1", "other") == "columns"
    assert not is_data("#") and is_data('"#"')


def test_located_faults():
    p = read_row('chr1\t5\t9\t"name\t1', "peaks")
    assert p.column == 10 and p.fault.detail == "a quote is not closed"


def test_text_resumes_at_an_anchor():
    text = "\n".join(["# head", "chr1\t1\t2\ta\t1", 'chr1\t3\t4\t"broken\t1', "not an anchor", "chr2\t5\t6\tb\t.", "chr2\t9\t8\tc\t.", "chr3\t7\t8\td", 'chr3\t1\t2\t"x\ny"\t3'])
    got = [(r.line, r.fault.reason if r.fault else r.values["chrom"]) for r in read_text(text, "peaks")]
    assert got == [(2, 1), (3, "quoting"), (5, 2), (6, "value"), (7, "columns"), (8, 3)]
    crlf = read_text("chr1\t1\t2\t5\r\nchr1\t2\t3\t6\r\n", "lifted")
    assert [r.values.get("source_index") for r in crlf] == [5, 6]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='"\t\n\rab1', max_size=30))
def test_any_text_ends(text):
    rows = read_text(text, "lifted")
    assert all(r.fault or r.values for r in rows)
    read_row(text, "peaks")


def test_frames(spark):
    rows = [(1, "lifted", "chr1\t1\t2\t3", 9), (2, "peaks", None, 9), (3, None, "x", 9), (4, "lifted", "bad", 9), (4, "lifted", "bad", 9)]
    df = spark.createDataFrame(rows, "record_id long, feed string, line string, reason int")
    got = sorted((r.record_id, r.reason or "ok") for r in parse_records(df).collect())
    assert got == [(1, "ok"), (3, "columns"), (4, "columns"), (4, "columns")]
    assert parse_records(df.limit(0)).count() == 0
    files = spark.createDataFrame([("f", "chr1\t1\t2\t3\nchr1\t1"), ("g", None)], "path string, text string")
    got = sorted((r.path, r.line, r.reason or "ok") for r in parse_files(files, "lifted").collect())
    assert got == [("f", 1, "ok"), ("f", 2, "columns")]


def test_rows_of_files_are_read_as_text(spark, monkeypatch):
    from varloom.sources import records

    rows = [("peaks", "f", 1, '"chr5\t1\t2\ta\t.'), ("peaks", "f", 2, "chr7\t1\t2\tb\t1"), ("peaks", "f", 3, 'chr8\t1\t2\t"two\nlines"\t.'), ("peaks", "f", 4, 'chr9\t5\t9\t"end"\t.'), ("peaks", "f", 5, None), ("peaks", "f", 6, "chr1\t9\t3\tx\t."), ("lifted", "g", 7, "1\t2\t3\t4"), ("other", "h", 1, "1"), (None, "h", 1, "1")]
    df = spark.createDataFrame(rows, "feed string, file_name string, line_no int, line string")
    want = [("f", 1, "quoting"), ("f", 2, None), ("f", 3, None), ("f", 5, None), ("f", 7, "value"), ("g", 1, None)]
    for block in (5_000, 3, 2):
        got = sorted((r.path, r.line, r.reason) for r in records.parse_lines(df, block=block).collect())
        assert got == want
    assert records.parse_lines(df.limit(0)).count() == 0
