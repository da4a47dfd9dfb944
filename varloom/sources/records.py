"""Tab-separated records with quoting: an error-recovering recursive-descent reader.

Grammar, one procedure per rule::

    text   = record { NEWLINE record }
    record = field { TAB field } [ CR ]
    field  = quoted | bare
    quoted = '"' { any character but '"' | '""' } '"'     (a TAB or the record's end must follow)
    bare   = { any character but '"' and TAB }

Values are checked by typed columns. A fault is located (line and column) and typed: ``quoting``,
``columns`` or ``value``, the first of these that holds. In text mode a broken quote does not
swallow what follows: reading resumes at the next *anchor*, a line start from which the leading
columns of the feed parse and validate. In row mode every row is one record and the next row is the
anchor.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

LIMIT = 250_000_000
LONG_MAX = 2**63 - 1
_DIGITS = re.compile(r"[0-9]+\Z")
_SCORE = re.compile(r"(?:\.|[0-9]+(?:\.[0-9]+)?)\Z")
_CHROM = re.compile(r"(?:[cC][hH][rR])?([1-9]|1[0-9]|2[0-2])\Z")
_BARE = re.compile(r'[^"\t]*')
_BARE_LINE = re.compile(r'[^"\t\n]*')
_INNER = re.compile(r'(?:[^"]|"")*')


class Fault(Exception):
    """A syntax or value error at an offset of the text."""

    def __init__(self, reason: str, at: int, detail: str, resume: int | None = None):
        super().__init__(detail)
        self.reason, self.at, self.detail = reason, at, detail
        self.resume = at if resume is None else resume  # where the search for the next record begins


def _chrom(s: str) -> int:
    if not (m := _CHROM.match(s)):
        raise ValueError("chrom is not 1..22")
    return int(m[1])


def _position(s: str) -> int:
    if not _DIGITS.match(s) or len(s.lstrip("0")) > 9 or int(s) > LIMIT:
        raise ValueError(f"position is not 0..{LIMIT}")
    return int(s)


def _score(s: str) -> float | None:
    if not _SCORE.match(s):
        raise ValueError("score is neither a dot nor a number")
    return None if s == "." else float(s)


def _index(s: str) -> int:
    if not _DIGITS.match(s) or len(s.lstrip("0")) > 19 or int(s) > LONG_MAX:
        raise ValueError("source_index is not a signed 64-bit integer")
    return int(s)


#: Columns of each feed with their readers.
FEEDS = {
    "peaks": (("chrom", _chrom), ("start", _position), ("end", _position), ("name", str), ("score", _score)),
    "lifted": (("chrom", _chrom), ("start", _position), ("end", _position), ("source_index", _index)),
}


def is_data(line: str | None) -> bool:
    """Not null, blank, a comment or a ``track``/``browser`` line."""
    return bool(line) and not line.isspace() and not line.startswith(("#", "track", "browser"))


@dataclass
class Parsed:
    line: int
    values: dict = field(default_factory=dict)
    fault: Fault | None = None
    column: int = 0


class Reader:
    """Recursive descent over one text; ``whole`` makes the text a single record (row mode)."""

    def __init__(self, text: str, feed: str, whole: bool):
        self.text, self.whole, self.n, self.pos = text, whole, len(text), 0
        self.spec = FEEDS[feed]
        self.bare_rx = _BARE if whole else _BARE_LINE

    def _at_end(self, i: int) -> bool:
        """Whether a record may end at ``i``: the text's end, or in text mode a line's; a CR may stand before.

        In row mode ``read_row`` has taken the one closing CR off.
        """
        if i >= self.n:
            return True
        if self.whole:
            return False
        return self.text[i] == "\n" or self.text.startswith("\r\n", i) or (self.text[i] == "\r" and i + 1 == self.n)

    def quoted(self) -> str:
        begin = self.pos
        m = _INNER.match(self.text, begin + 1)
        i = m.end()
        if i >= self.n:
            raise Fault("quoting", begin, "a quote is not closed")
        i += 1
        if not (self._at_end(i) or self.text[i] == "\t"):
            raise Fault("quoting", i, "text after a closing quote", begin)
        self.pos = i
        return m[0].replace('""', '"')

    def bare(self) -> str:
        i = self.bare_rx.match(self.text, self.pos).end()
        if i < self.n and self.text[i] == '"':
            raise Fault("quoting", i, "a quote in an unquoted field")
        s = self.text[self.pos : i]
        if s.endswith("\r") and self._at_end(i - 1):
            s, i = s[:-1], i - 1
        self.pos = i
        return s

    def fields(self) -> list[tuple[int, str]]:
        out = []
        while True:
            at = self.pos
            quoted = at < self.n and self.text[at] == '"'
            out.append((at, self.quoted() if quoted else self.bare()))
            if self.pos < self.n and self.text[self.pos] == "\t":
                self.pos += 1
                continue
            return out

    def record(self) -> dict:
        got = self.fields()
        if len(got) != len(self.spec):
            raise Fault("columns", got[-1][0], f"{len(got)} fields, not {len(self.spec)}")
        values = {}
        for (at, s), (name, read) in zip(got, self.spec):
            try:
                values[name] = read(s)
            except ValueError as e:
                raise Fault("value", at, str(e)) from None
        if values["start"] >= values["end"]:
            raise Fault("value", got[1][0], "start is not below end")
        return values

    def anchor(self, i: int) -> int:
        """The next line start at or after ``i`` from which chrom, start and end parse and validate."""
        while (i := self.text.find("\n", i)) >= 0:
            i += 1
            try:
                self.pos = i
                for k, (_, read) in enumerate(self.spec[:3]):
                    read(self.quoted() if self.text[self.pos : self.pos + 1] == '"' else self.bare())
                    if k < 2:
                        if self.text[self.pos : self.pos + 1] != "\t":
                            raise ValueError
                        self.pos += 1
                return i
            except (Fault, ValueError):
                continue
        return self.n

    def _torn(self, begin: int, f: Fault) -> Fault:
        """The fault of a record that failed; over several lines of which one is an anchor, the quote that swallowed it is the fault."""
        end = self.pos
        if self.whole or f.reason == "quoting" or "\n" not in self.text[begin:end]:
            return f
        at = self.anchor(begin)
        self.pos = end
        quote = self.text.find('"', begin, at)
        return Fault("quoting", quote, "a quote is not closed before the next record", begin) if quote >= 0 and at < end else f

    def parse(self) -> Iterator[Parsed]:
        line, seen = 1, 0
        while self.pos < self.n:
            begin = self.pos
            line += self.text.count("\n", seen, begin)
            seen = begin
            stop = self.n if self.whole else (self.text.find("\n", begin) + 1 or self.n + 1) - 1
            if not is_data(self.text[begin:stop]):
                self.pos = stop + 1
                continue
            try:
                yield Parsed(line, self.record())
            except Fault as f:
                f = self._torn(begin, f)
                yield Parsed(line, {}, f, f.at - self.text.rfind("\n", 0, f.at) if not self.whole else f.at + 1)
                if f.reason == "quoting":
                    self.pos = self.anchor(f.resume) if not self.whole else self.n
                    continue
            if not self._at_end(self.pos) or self.whole:  # rest of a line that failed for another reason
                nl = self.text.find("\n", self.pos)
                self.pos = self.n if self.whole or nl < 0 else nl
            self.pos = min(self.n, self.pos + (2 if self.text.startswith("\r\n", self.pos) else 1))


def read_text(text: str, feed: str) -> list[Parsed]:
    """All records and faults of a text of many lines."""
    return list(Reader(text, feed, whole=False).parse())


def read_row(line: str | None, feed: str | None) -> Parsed | None:
    """The record or fault of one line; None for null, blank and comment lines. An unknown feed is a ``columns`` fault."""
    if line is not None and line.endswith("\r"):
        line = line[:-1]
    if not is_data(line):
        return None
    if feed not in FEEDS:
        return Parsed(1, {}, Fault("columns", 0, f"no feed {feed}"), 1)
    reader = Reader(line, feed, whole=True)
    try:
        values = reader.record()
        return Parsed(1, values)
    except Fault as f:
        return Parsed(1, {}, f, f.at + 1)


OUT = "record_id long, feed string, chrom int, start long, end long, name string, score double, source_index long, reason string, at int, detail string"


def parse_records(df: DataFrame, record_id: str = "record_id", feed: str = "feed", line: str = "line") -> DataFrame:
    """Typed columns of every data line, and ``reason``, ``at`` (column) and ``detail`` of those that fail.

    Lines that are null, blank or comments give no row; failed lines have null typed columns. Rows
    are read once, in Arrow batches, without a shuffle: a line is a record of its own, so neither
    hot feeds nor repeated lines matter. An empty input gives an empty result.
    """
    src = df.select(F.col(record_id).alias("record_id"), F.col(feed).alias("feed"), F.col(line).alias("line"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rid, fd, text in zip(b["record_id"], b["feed"], b["line"]):
                p = read_row(text, fd)
                if p is None:
                    continue
                v, f = p.values, p.fault
                rows.append((rid, fd, v.get("chrom"), v.get("start"), v.get("end"), v.get("name"), v.get("score"), v.get("source_index"), f and f.reason, p.column if f else None, f and f.detail))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")], dtype=object)
            yield out

    return src.mapInPandas(run, OUT)


FILE_OUT = "path string, line long, chrom int, start long, end long, name string, score double, source_index long, reason string, at int, detail string"
#: Rows of one block of text that ``parse_lines`` puts together.
BLOCK = 5_000


def parse_files(df: DataFrame, feed: str | Column, path: str = "path", text: str = "text", first: str | Column | None = None) -> DataFrame:
    """As ``parse_records`` for texts of many lines; after a broken quote reading resumes at the next anchor.

    ``feed`` names the feed of all texts, or is a column of it. Lines are counted from ``first`` (one by default). Null texts give no row.
    """
    kind = F.lit(feed) if isinstance(feed, str) else feed
    begin = F.lit(1) if first is None else F.col(first) if isinstance(first, str) else first
    src = df.where(F.col(text).isNotNull()).select(F.col(path).cast("string").alias("path"), F.col(text).alias("text"), kind.alias("feed"), begin.cast("long").alias("first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, t, fd, at in zip(b["path"], b["text"], b["feed"], b["first"]):
                rows = []
                for r in read_text(t, fd):
                    v, f = r.values, r.fault
                    rows.append((p, at + r.line - 1, v.get("chrom"), v.get("start"), v.get("end"), v.get("name"), v.get("score"), v.get("source_index"), f and f.reason, r.column if f else None, f and f.detail))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in FILE_OUT.split(", ")], dtype=object)

    return src.where(F.col("feed").isin(list(FEEDS))).mapInPandas(run, FILE_OUT)


def parse_lines(df: DataFrame, feed: str = "feed", path: str = "file_name", number: str = "line_no", line: str = "line", block: int = BLOCK) -> DataFrame:
    """The records of files that are given row by row, each row beginning a record, in blocks of so many rows of a file.

    The rows of a block are one text, read with error recovery: a quote that is not closed does not swallow the rows behind it
    beyond the next anchor. A row that is no anchor and stands right behind a broken quote is part of that fault. Null rows are
    empty lines; rows of one number stand in the order of their texts; a file of any length is many blocks.
    """
    x = df.select(F.col(feed).alias("feed"), F.col(path).alias("path"), F.col(number).cast("long").alias("no"), F.coalesce(F.col(line), F.lit("")).alias("line"))
    x = x.withColumn("block", F.floor(F.col("no") / block))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda r: r["line"]), "\n")
    size = F.sum(1 + F.length("line") - F.length(F.replace("line", F.lit("\n"), F.lit(""))))
    blocks = x.groupBy("feed", "path", "block").agg(text.alias("text"), size.alias("size"))
    before = W.partitionBy("feed", "path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # one row a block
    sizes = x.groupBy("feed", "path", "block").agg(size.alias("size")).select("feed", "path", "block", (1 + F.coalesce(F.sum("size").over(before), F.lit(0))).alias("first"))
    keyed = blocks.drop("size").join(sizes, ["feed", "path", "block"])
    return parse_files(keyed, F.col("feed"), "path", "text", "first")
