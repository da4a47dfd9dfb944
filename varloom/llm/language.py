"""Language of every document and of every stretch of a mixed one, with a confidence.

Character n-grams and whole words of labelled text go into one bit-sliced Bloom filter: slot
``h`` holds a bit for every language that put an n-gram there, so a lookup of ``k`` slots, combined
by AND, returns all languages that contain the n-gram at once. A sentence's n-grams give a count
for each language; the share that a language's slots would match by chance is taken off. A text is cut
into sentences, and the most likely run of languages over them (each change costs a fixed number of
n-grams) gives the stretches. What is no full sentence (identifiers, numbers, tables, short
phrases) has no say and belongs to what surrounds it.

The filter is fitted twice: on the labelled sentences, then also on the words of a bounded number of
documents that the first fit finds to be mostly in the language their label names. A word goes to a
language only if its documents hold it about as often as any other language's do, which keeps out
foreign sentences and phrases.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from ..session import kept, ship, spread

#: Slots of the filter, slots per n-gram, orders of the n-grams, extra weight of a whole word.
SLOTS, HASHES, ORDERS, WHOLE = 1 << 20, 3, (2, 3, 4, 5), 3
#: N-grams that a change of language must be worth; words of a full sentence.
CHANGE, FULL = 12.0, 4
#: Bounds of what the filter is fitted on: labelled sentences, and documents (those of the lowest hashes).
MOST_SAMPLES, MOST_DOCS = 100_000, 4_000
#: A word is a language's if this share of the highest rate among the languages is reached, in at least so many documents.
RATE, LEAST_DOCS = 0.05, 2
#: Share of a document's sentences that the first fit must find to be in the label's language; the rest may be its errors.
MOSTLY = 0.75

#: Codes and names of languages, without accents and in lower case. Any language of the labelled sentences
#: is known by its own code as well; ``names`` adds further notations.
NAMES = {
    "cs": "cs ces cze czech cestina",
    "da": "da dan danish dansk",
    "de": "de deu ger german deutsch",
    "en": "en eng english",
    "es": "es spa spanish espanol castellano",
    "fr": "fr fra fre french francais",
    "it": "it ita italian italiano",
    "ja": "ja jpn japanese",
    "nl": "nl nld dut dutch nederlands",
    "pl": "pl pol polish polski",
    "pt": "pt por portuguese portugues",
    "ru": "ru rus russian русскии",
    "sv": "sv swe swedish svenska",
    "tr": "tr tur turkish turkce",
    "uk": "uk ukr ukrainian украінська",
    "zh": "zh zho chi chinese",
}
_CODE = {n: code for code, names in NAMES.items() for n in names.split()}

# letters that the notations above have with accents, for the comparison in the scan
_ACCENTS = "\u00e1\u00e0\u00e2\u00e3\u00e4\u00e5\u00e7\u00e9\u00e8\u00ea\u00eb\u00ed\u00ec\u00ee\u00ef\u00f1\u00f3\u00f2\u00f4\u00f5\u00f6\u00fa\u00f9\u00fb\u00fc\u010d\u0161\u0439\u0457"
_PLAIN = "aaaaaaceeeeiiiinooooouuuucs\u0438\u0456"

_LETTERS = regex.compile(r"\b[\p{L}\p{M}]{2,}+\b")
_ASCII_LETTERS = re.compile(r"\b[A-Za-z]{2,}\b", re.ASCII)
# texts of letters without combining marks and of common signs, which the standard library matches faster
_ODD = re.compile(r"[^\t-\r\x20-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u024f\u0370-\u0482\u048a-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u2190-\u22ff]")
_PLAIN_LETTERS = re.compile(r"\b[^\W\d_]{2,}\b")
# a sentence ends at a mark, maybe with closing signs, that blank space follows; blank lines and list marks end one as well
_MARK = r"""[.?!\u2026\u061f\u06d4\u0964\u0965\u1362\u1367\u104b][)\]}"'\u00bb\u201d\u2019\u203a*_]{0,3}"""
# full-width marks end a sentence without a blank
_WIDE = r"[\u3002\uff01\uff1f\uff61][\u300d\u300f\uff09\u201d\u2019]{0,3}"
_CUT = re.compile(rf"({_MARK})\s+|({_WIDE})\s*|\n[ \t\r]*\n\s*|\n(?=[ \t]*[-*\u2022] )")
_ENDED = re.compile(rf"(?:{_MARK}|{_WIDE})\s*$")
# scripts written without blanks: their runs count as overlapping pairs of characters
_NO_BLANKS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")


def plain(word: str) -> str:
    """Lower case without accents, so that texts that lost theirs look alike."""
    return "".join([c for c in unicodedata.normalize("NFKD", word.casefold()) if not unicodedata.combining(c)])


def language_words(text: str) -> list[str]:
    """Words of letters only; sequences over a few letters and very long runs are identifiers."""
    if text.isascii():
        found = _ASCII_LETTERS.findall(text)
    elif not _ODD.search(text):
        found = _PLAIN_LETTERS.findall(text)
    else:
        found = _LETTERS.findall(text)
        if _NO_BLANKS.search(text):
            found = [x for w in found for x in ([w[i : i + 2] for i in range(len(w) - 1)] if _NO_BLANKS.search(w) else [w])]
    return [w for w in found if len(w) < 12 or (len(w) <= 40 and len(set(w)) > 5)]


def notations(langs: Iterable[str], names: dict[str, str] | None = None) -> dict[str, str]:
    """Every notation with its code: the fixed ones, the codes of ``langs``, and ``names`` (code to names parted by blanks)."""
    more = {plain(n): code for code, ns in (names or {}).items() for n in [code, *ns.split()]}
    return {**{plain(lang): lang for lang in langs}, **_CODE, **more}


def label_code(label: str | None, known: dict[str, str] = _CODE) -> str | None:
    """Two-letter code of a label in any notation; ``''`` for one that names no language known here."""
    if label is None:
        return None
    base = regex.split(r"[-_\s(]", plain(label.strip()))[0]
    return known.get(base, "")


class Filters:
    """The bit-sliced Bloom filter of all languages."""

    def __init__(self, samples: Iterable[tuple[str, str]], slots: int = SLOTS, hashes: int = HASHES):
        pairs = {(lang, w) for lang, text in samples if lang and text for w in map(plain, language_words(text))}
        self.langs = sorted({lang for lang, _ in pairs})
        if len(self.langs) > 64:
            raise ValueError("at most 64 languages fit a slot")
        self.slots, self.hashes = slots, hashes
        kind = np.uint8 if len(self.langs) <= 8 else np.uint64
        self.bits = np.zeros(slots, dtype=kind)
        at = {lang: kind(1 << i) for i, lang in enumerate(self.langs)}
        for lang, word in pairs:
            np.bitwise_or.at(self.bits, self._places(self._grams(word)).ravel(), at[lang])
        column = [(self.bits >> kind(i)) & kind(1) for i in range(len(self.langs))]
        #: chance that an n-gram no sentence of the language holds is found in its slice
        self.chance = np.array([float(c.mean()) ** hashes for c in column])

    @staticmethod
    def _grams(word: str) -> list[bytes]:
        w = f" {word} "
        return [w[i : i + n].encode() for n in ORDERS for i in range(len(w) - n + 1)] + [f"={word}".encode()]

    def _places(self, grams: list[bytes]) -> np.ndarray:
        a = np.array([zlib.crc32(g) for g in grams], dtype=np.uint64)
        b = np.array([zlib.crc32(g, 0x9E3779B9) | 1 for g in grams], dtype=np.uint64)
        return np.stack([(a + b * np.uint64(i)) % np.uint64(self.slots) for i in range(self.hashes)])

    def counts(self, word: str) -> np.ndarray:
        """For each language the number of the word's n-grams it holds, less those expected by chance; last, the number of n-grams."""
        grams = self._grams(word)
        masks = np.bitwise_and.reduce(self.bits[self._places(grams)], axis=0)
        weight = np.ones(len(grams))
        weight[-1] = WHOLE
        n = weight.sum()
        kind = masks.dtype.type
        found = np.array([(((masks >> kind(i)) & kind(1)) * weight).sum() for i in range(len(self.langs))])
        return np.append((found - n * self.chance) / (1 - self.chance), n)


@dataclass(slots=True)
class Unit:
    begin: int
    end: int
    full: bool
    words: list[str]


def units(text: str) -> list[Unit]:
    """Sentences and what stands between them, in reading order."""
    out, at = [], 0
    ends = [(m.end(m.lastindex), m.end(), True) if m.lastindex else (m.start(), m.end(), False) for m in _CUT.finditer(text)] + [(len(text), len(text), False)]
    for stop, nxt, marked in ends:
        part = text[at:stop]
        words = language_words(part)
        if words:
            out.append(Unit(at, stop, len(words) >= FULL and (marked or bool(_ENDED.search(part.rstrip()[-5:]))), words))
        at = nxt
    return out


@dataclass
class Stretch:
    lang: str
    confidence: float
    begin: int
    end: int
    sentences: int


class Detector:
    """Stretches of texts; keeps the counts of the words it has seen, up to a bound."""

    def __init__(self, filters: Filters, most: int = 200_000):
        self.filters, self.most = filters, most
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(filters.langs) + 1))

    def _new(self, word: str) -> int:
        k = self.known[word] = len(self.known)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[k] = self.filters.counts(plain(word))
        return k

    def _counts(self, parts: list[list[str]]) -> np.ndarray:
        """Sums of the words' counts, one row for each (non-empty) list of words."""
        if len(self.known) >= self.most:
            self.known.clear()
        get, new = self.known.get, self._new
        at = [new(w) if (k := get(w)) is None else k for words in parts for w in words]
        starts = np.cumsum([0] + [len(words) for words in parts[:-1]])
        return np.add.reduceat(self.table[at], starts, axis=0)

    @staticmethod
    def _run(e: np.ndarray) -> list[int]:
        """The best run of languages over the sentences."""
        score, back = e[0].copy(), []
        for row in e[1:]:
            top = int(score.argmax())
            stay = score >= score[top] - CHANGE
            back.append(np.where(stay, np.arange(len(score)), top))
            score = np.maximum(score, score[top] - CHANGE) + row
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def __call__(self, text: str | None) -> list[Stretch]:
        """The longest stretches in one language; none for a text without a full sentence."""
        full = [u for u in units(text)] if text else []
        full = [u for u in full if u.full]
        if not full or not self.filters.langs:
            return []
        e = self._counts([u.words for u in full])
        e, n = e[:, :-1], e[:, -1]
        tops = e.argmax(axis=1)
        if (tops == tops[0]).all():  # one language is the best of every sentence
            path = [int(tops[0])] * len(full)
        else:
            path = self._run(e)
        out, i = [], 0
        while i < len(full):
            j = i
            while j + 1 < len(full) and path[j + 1] == path[i]:
                j += 1
            total, size = e[i : j + 1].sum(axis=0), float(n[i : j + 1].sum())
            own = total[path[i]]
            other = max((t for k, t in enumerate(total) if k != path[i]), default=0.0)
            lead = (own - other) / max(size, 1.0)
            begin = 0 if i == 0 else full[i].begin
            out.append(Stretch(self.filters.langs[path[i]], 1 / (1 + math.exp(-12 * lead)), begin, len(text) if j + 1 == len(full) else full[j + 1].begin, j - i + 1))
            i = j + 1
        return out

    def whole(self, text: str | None) -> list[Stretch]:
        """The language of a text without a full sentence, by all its words; none for a text without words."""
        words = language_words(text) if text else []
        if not words or not self.filters.langs:
            return []
        e = self._counts([words])[0]
        order = np.argsort(-e[:-1], kind="stable")
        lead = (e[order[0]] - (e[order[1]] if len(order) > 1 else 0.0)) / max(float(e[-1]), 1.0)
        return [Stretch(self.filters.langs[int(order[0])], 1 / (1 + math.exp(-12 * lead)), 0, len(text), 0)]


def lowest_hashes(df: DataFrame, cols: list[str], most: int) -> DataFrame:
    """At most ``most`` distinct rows of ``cols``, those of the lowest hashes, the same on every run.

    Rows are counted first and thinned by a threshold on the hash, so only about twice as many are ever sorted.
    """
    h = F.xxhash64(*cols)
    rows = df.select(*cols)
    n = rows.agg(F.approx_count_distinct(h)).first()[0]
    if n > 3 * most:
        rows = rows.where(h < F.lit(int(-(2**63) + 2**64 * (2 * most / n))))
    return rows.distinct().orderBy(h, *cols).limit(most)


def fit_filters(docs: DataFrame, samples: list[tuple[str, str]], most: int = MOST_DOCS, names: dict[str, str] | None = None) -> Filters:
    """Both fits, for ``docs`` of ``doc_id, text, label``.

    At most ``most`` identifiers are chosen for the second fit: of the documents whose label names a
    language, those with the lowest hashes. Only their texts leave the scan, spread over the tasks.
    """
    spark = docs.sparkSession
    first = Filters(samples)
    if not first.langs:
        return first
    shared = ship(spark, first)
    known = notations(first.langs, names)
    named = sorted(n for n, code in known.items() if code in first.langs)
    base = F.translate(F.split(F.lower(F.trim("label")), r"[-_\s(]")[0], _ACCENTS, _PLAIN)
    usable = docs.where(base.isin(named) & F.col("doc_id").isNotNull())
    ids = [r["doc_id"] for r in lowest_hashes(usable, ["doc_id"], most).collect()]  # at most `most` numbers
    chosen = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    some = spread(usable.join(F.broadcast(chosen), "doc_id", "left_semi"), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = Detector(shared())
        for b in batches:
            rows = []
            for t, given in zip(b["text"], b["label"]):
                got, code = detect(t), label_code(given, known)
                if got and sum(x.sentences for x in got if x.lang == code) >= MOSTLY * sum(x.sentences for x in got):
                    rows += [(code, w) for w in {plain(w) for u in units(t) if u.full for w in u.words} | {""}]
            yield pd.DataFrame(rows, columns=["lang", "word"])

    counts = some.mapInPandas(run, "lang string, word string").groupBy("lang", "word").count().where(F.col("count") >= LEAST_DOCS).collect()
    size = {r["lang"]: r["count"] for r in counts if r["word"] == ""}
    rate: dict[str, dict[str, float]] = {}
    for r in counts:
        if r["word"]:
            rate.setdefault(r["word"], {})[r["lang"]] = r["count"] / size[r["lang"]]
    more = [(lang, w) for w, by in rate.items() for lang, x in by.items() if x >= RATE * max(by.values())]
    return Filters([*samples, *more])


OUT = "doc_id long, label string, segment int, n_segments int, lang string, confidence double, from_char int, to_char int, sentences int"


def language_segments(docs: DataFrame, samples: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str | Column = "lang", sample_lang: str = "lang", sentence: str = "sentence", most: int = MOST_SAMPLES, most_docs: int = MOST_DOCS, names: dict[str, str] | None = None) -> DataFrame:
    """One row for each stretch of each document with words; ``label`` is the stored label's code.

    ``label`` is null for a missing one and empty for one that names none of the languages known
    (``NAMES``, the codes of the samples, and ``names``). A text without a full sentence (a mark at its
    end and four words) is one stretch of 0 ``sentences``, judged by all its words; null, empty and
    blank texts and texts without words give no row. The filters, of some MB, are fitted on at most
    ``most`` sentences of ``samples`` and ``most_docs`` documents, those of the lowest hashes, and
    broadcast. One pass over the documents, whole texts, without a shuffle where the scan has a task
    for every core; repeated rows give repeated rows.
    """
    spark = docs.sparkSession
    lab = F.col(label) if isinstance(label, str) else label
    texts = docs.where(F.length(text) > 0).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), lab.cast("string").alias("label"))
    usable = samples.select(F.col(sample_lang).alias("lang"), F.col(sentence).alias("sentence")).where("lang is not null and sentence is not null")
    rows = lowest_hashes(usable, ["lang", "sentence"], most).collect()
    fitted = fit_filters(texts, [(r[0], r[1]) for r in rows], most_docs, names)
    filters, known = ship(spark, fitted), notations(fitted.langs, names)
    src, key = spread(texts, "doc_id"), f"detector {uuid.uuid4().hex}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = kept(key, lambda: Detector(filters()))  # the words it has counted serve later tasks too
        for b in batches:
            got = []
            for d, t, given in zip(b["doc_id"], b["text"], b["label"]):
                stretches = detect(t) or detect.whole(t)
                code = label_code(given, known)
                got += [(d, code, k, len(stretches), s.lang, s.confidence, s.begin, s.end, s.sentences) for k, s in enumerate(stretches, 1)]
            yield pd.DataFrame(got, columns=[c.split()[0] for c in OUT.split(", ")])

    return src.mapInPandas(run, OUT)


def wrong_labels(segments: DataFrame) -> DataFrame:
    """Rows of ``language_segments`` whose document has a full sentence and lacks a label, names another language, or is mixed."""
    return segments.where("sentences > 0").where((F.col("n_segments") > 1) | F.col("label").isNull() | (F.col("label") != F.col("lang")))
