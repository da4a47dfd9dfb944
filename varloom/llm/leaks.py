"""Held-out evaluation passages inside a training corpus.

Every passage gives the pairs of words of its windows of three (neighbours, and pairs with one word
between) that hold one of its rare words. Their hashes are the set of normalised n-grams: the corpus
is read once, the pairs of each document's windows are looked up, and where a passage has pairs in a
document its stretch there is verified by a local alignment of words. Changed, lost and added words
leave pairs of the window intact on either side of them.

Verification: other sentences may stand between the passage's own at a small fixed cost; along the
alignment the longest stretch is taken that covers twelve words of the passage, of which fewer than
one in three differ, and holds at least half of its rare words there, which a text of the same frame
with other names and numbers does not; what foreign sentences part must hold an agreeing rare word on
either side. A stretch begins and ends with two agreeing words or a rare
one, as a single common word may agree by chance. What was found, or refused, is blanked and the
rest aligned again, so every copy and piece gives a span of its own.

Passages with the same words are one passage with several items. Sentences that several different
passages share (standing sentences) stay in the passages, but their words are never rare, so a hit
needs words of the passage's own. A sentence with names or numbers that only a few passages share is
no standing sentence: it belongs to each of them. Sentences and words are counted over all passages.

The set is broadcast if the passages have at most ``BROADCAST_CHARS`` characters, which is counted
first. Beyond that the n-grams are joined: a filter of fixed size is broadcast, pairs of the
documents that pass it are joined with those of the passages, and the candidates' texts and passages
are brought together for the same verification. Both ways give the same rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import Scratch, kept, ship, spread

#: Least words of a passage in a hit.
LEAST = 12
#: Pairs of neighbours that a window must hold before it is aligned.
PAIRS = 3
#: Scores of the alignment: a word that agrees, one that is changed, lost or added, and a run of foreign sentences.
SAME, EDIT, JUMP = 2, -1, -4
#: A name or number is rare if at most this share of the passages (but three at least) hold it; share of them that must agree.
#: A passage with fewer than two of them takes all its words that few passages hold.
RARE, AGREE = 0.025, 1 / 2
#: Words, beyond its length, that may stand between two pieces of a passage in one window.
APART = 60
#: A run of pieces longer than this many lengths of the passage is aligned in windows that overlap by several of its lengths.
WINDOW, OVERLAP = 20, 4
#: Most characters of passages whose index is broadcast (it takes some tens of times that).
BROADCAST_CHARS = 8_000_000
#: Bits of the filter of n-grams that goes to the workers where the set itself is too large.
FILTER_BITS = 1 << 27
#: Words of documents that are looked up at once.
CHUNK_WORDS = 200_000

_INLINE = re.compile(r"</?(?:i|b|em|strong|u|s|span|a|sup|sub|code|mark|small|font)\b[^<>\n]{0,200}>", re.I)
_TAG = re.compile(r"<[^<>\n]{1,200}>|&(?:\w{2,10}|#\w{1,7});|(?<=\])\([^()\s]{1,400}\)")
_HYPHEN_BREAK = re.compile(r"(?<=\w)[-\u2010\u2011][ \t]*\r?\n[ \t]*(?=\w)")
_BREAKS = ("-\n", "-\r", "- ", "-\t", "\u2010", "\u2011")
_SENTENCE = re.compile(r"(?<=[.?!])\s+|(?<=[\u3002\uff01\uff1f\u0964])\s*")
_RAW_WORD = re.compile(r"[\w\u0300-\u036f\u00ad\u200b-\u200f\u2060-\u2064\ufeff]+(?:[-\u2010\u2011'\u2019*~`]+[\w\u0300-\u036f\u00ad\u200b-\u200f\u2060-\u2064\ufeff]+)*")
_TOKEN = re.compile(r"\S+")
_JOINERS = set("-\u2010\u2011'\u2019*~`_")
#: Ranges of scripts that are written without blanks between words; each character is a word.
_NO_BLANKS = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


class _Forms(dict):
    """What each character adds to words in normal form: its letters, nothing (joins), or a blank (parts); filled as characters are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        plain = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", c).casefold())
        letters = "".join([x for x in plain if x.isalnum()])
        if any(lo <= code <= hi for lo, hi in _NO_BLANKS) and (letters or unicodedata.category(c)[0] == "M"):
            out = f" {letters} " if letters else ""
        elif letters:
            out = letters
        else:
            out = "" if c in _JOINERS or unicodedata.category(c) in ("Mn", "Mc", "Me", "Cf") else " "
        self[code] = out
        return out


class Words:
    """Words of texts in normal form, their codes and places; keeps the tokens it has seen, up to a bound."""

    def __init__(self, most: int = 300_000):
        self.most, self.forms = most, _Forms()
        self.known: dict[str, tuple[str, ...]] = {}
        self.coded: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def prepare(text: str) -> str:
        """Markup and hyphens at line breaks replaced, in the same number of characters."""
        if "<" in text or "&" in text or "](" in text:
            text = _INLINE.sub(lambda m: "\u2060" * len(m[0]), text)
            text = _TAG.sub(lambda m: " " * len(m[0]), text)
        if any(b in text for b in _BREAKS):
            text = _HYPHEN_BREAK.sub(lambda m: "\u2060" * len(m[0]), text)
        return text

    def _words(self, token: str) -> tuple[str, ...]:
        return tuple(token.translate(self.forms).split())

    def __call__(self, text: str) -> list[str]:
        known, out = self.known, []
        for token in self.prepare(text).split():
            ws = known.get(token)
            if ws is None:
                ws = self._words(token)
                if len(token) <= 60:
                    if len(known) >= self.most:
                        known.clear()
                    known[token] = ws
            out += ws
        return out

    def codes(self, text: str) -> list[int]:
        """A code of 32 bits for every word, in the same order."""
        coded, out = self.coded, []
        for token in self.prepare(text).split():
            cs = coded.get(token)
            if cs is None:
                cs = tuple([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in self._words(token)])
                if len(token) <= 60:
                    if len(coded) >= self.most:
                        coded.clear()
                    coded[token] = cs
            out += cs
        return out

    def places(self, text: str, wanted: Iterable[int]) -> dict[int, tuple[int, int]]:
        """Where the words of these numbers, in a call with the same text, stand."""
        want, out, k = set(wanted), {}, 0
        for m in _TOKEN.finditer(self.prepare(text)):
            ws = self.known.get(m[0])
            n = len(self._words(m[0]) if ws is None else ws)
            if n and not want.isdisjoint(range(k, k + n)):
                out.update((k + i, (m.start() + b, m.start() + e)) for i, (b, e) in enumerate(self._within(m[0])))
            k += n
        return out

    def _within(self, token: str) -> list[tuple[int, int]]:
        out, begin, end = [], -1, -1
        for i, c in enumerate(token):
            parts = self.forms[ord(c)].split(" ") if self.forms[ord(c)] else ()
            for k, p in enumerate(parts):
                if k and begin >= 0:
                    out.append((begin, end))
                    begin = -1
                if p:
                    begin, end = (i if begin < 0 else begin), i + 1
        return out + ([(begin, end)] if begin >= 0 else [])


@dataclass
class Passage:
    words: list[str]
    ends: set[int]  # indices of the words that end a sentence
    items: list[int]
    own: list[bool]  # whether a word stands in a sentence of the passage's own
    rare: set[str] = field(default_factory=set)
    pairs: set[tuple[str, str]] = field(default_factory=set)


def named(sentence: str, words: Words) -> set[str]:
    """Names and numbers of a sentence in normal form: words with a digit or a capital; the first word only with a hyphen."""
    raw = _RAW_WORD.findall(sentence)
    return {x for k, w in enumerate(raw) if any(c.isdigit() for c in w) or (w[0].isupper() and (k or "-" in w)) for x in words(w)}


def sentences(text: str, words: Words) -> list[tuple[str, tuple[str, ...]]]:
    """The sentences of a passage and their words."""
    return [(s, ws) for s in _SENTENCE.split(text) if (ws := tuple(words(s)))]


def few(n: int) -> int:
    """How many of ``n`` passages may hold what is rare."""
    return max(3, int(RARE * n))


def make_passage(text: str, items: list[int], standing: Iterable[tuple[str, ...]], words: Words) -> Passage | None:
    """A passage without its rare words; None if it can't give a hit."""
    shared, all_words, own, ends = set(standing), [], [], set()
    for _, ws in sentences(text, words):
        all_words += ws
        own += [ws not in shared] * len(ws)
        ends.add(len(all_words) - 1)
    if len(all_words) < LEAST or not any(own):
        return None
    return Passage(all_words, ends, items, own, pairs=set(zip(all_words, all_words[1:])))


def own_names(text: str, standing: Iterable[tuple[str, ...]], words: Words) -> set[str]:
    """Names and numbers of the sentences of the passage's own."""
    shared = set(standing)
    return {w for s, ws in sentences(text, words) if ws not in shared for w in named(s, words)}


def set_rare(p: Passage, uncommon: set[str], names: set[str]) -> None:
    """Rare words: those of ``uncommon`` in the passage's own sentences that are names, or all if there are fewer than two."""
    own = {w for w, o in zip(p.words, p.own) if o and w in uncommon}
    p.rare = own & names if len(own & names) > 1 else own


_MIX = np.uint64(0x9E3779B97F4A7C15)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits for two codes of words, in their order."""
    x = (a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) * _MIX
    return x ^ (x >> np.uint64(29))


def seeds(p: Passage) -> np.ndarray:
    """Hashes of the pairs, within windows of three words, that hold a rare word of the passage."""
    c = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in p.words], dtype=np.uint64)
    rare = np.array([o and w in p.rare for w, o in zip(p.words, p.own)])
    out = [pair_hash(c[:-g], c[g:])[rare[:-g] | rare[g:]] for g in (1, 2) if len(c) > g]
    return np.unique(np.concatenate(out))


class Index:
    """All passages, ready for the scan: counts over all of them, and postings of their n-grams."""

    def __init__(self, items: Iterable[tuple[int, str]]):
        words = Words()
        forms: dict[tuple[str, ...], tuple[str, list[int]]] = {}
        for i, text in items:
            ids = forms.setdefault(tuple(words(text or "")), (text or "", []))[1]
            if i not in ids:
                ids.append(i)
        seen, with_names = Counter(), set()
        for text, _ in forms.values():
            held = {}
            for s, ws in sentences(text, words):
                held.setdefault(ws, s)
            seen.update(held.keys())
            with_names |= {ws for ws, s in held.items() if named(s, words)}
        standing = {s for s, n in seen.items() if n > (few(len(forms)) if s in with_names else 1)}
        self.passages: list[Passage] = []
        names: set[str] = set()
        for text, ids in forms.values():
            if p := make_passage(text, ids, standing, words):
                self.passages.append(p)
                names |= own_names(text, standing, words)
        count = Counter(w for p in self.passages for w in set(p.words))
        uncommon = {w for w, n in count.items() if n <= few(len(self.passages))}
        for p in self.passages:
            set_rare(p, uncommon, names)
        self.post()

    def post(self) -> None:
        found = [seeds(p) for p in self.passages]
        keys = np.concatenate([np.zeros(0, np.uint64), *found])
        owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]
        self.bits = max(16, int(len(keys) * 16).bit_length())
        self.filter = np.zeros(1 << self.bits, dtype=bool)
        self.filter[self._slot(self.keys)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``keys`` and the passages that hold what stands there, one row for each."""
        at = np.flatnonzero(self.filter[self._slot(keys)])
        lo, hi = np.searchsorted(self.keys, keys[at], "left"), np.searchsorted(self.keys, keys[at], "right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.owner[np.repeat(lo, n) + step]


def align(passage: Passage, words: list[str]) -> list[tuple[int, int]]:
    """Path of the best local alignment: pairs of a passage word and a document word, -1 for none; a run of foreign sentences leaves no trace."""
    codes: dict[str, int] = {}
    doc = np.array([codes.setdefault(w, len(codes)) for w in words], dtype=np.int32)
    m, n = len(words), len(passage.words)
    rows = np.zeros((n + 1, m + 1), dtype=np.int32)
    slope = -EDIT * np.arange(m + 1, dtype=np.int32)
    gain = {}
    for i, w in enumerate(passage.words, 1):
        row, code = rows[i], codes.get(w, -1)
        if code not in gain:
            gain[code] = np.where(doc == code, SAME, EDIT)
        np.maximum(rows[i - 1][:-1] + gain[code], 0, out=row[1:])
        np.maximum(row, rows[i - 1] + EDIT, out=row)
        row[:] = np.maximum.accumulate(row + slope) - slope  # added words
        if i - 1 in passage.ends:
            row[:] = np.maximum(row, np.maximum.accumulate(row) + JUMP)  # other sentences
    i, j = (int(x) for x in np.unravel_index(int(rows.argmax()), rows.shape))
    path = []
    while i > 0 and j > 0 and (here := int(rows[i, j])) > 0:
        if here == rows[i - 1, j - 1] + (SAME if words[j - 1] == passage.words[i - 1] else EDIT):
            i, j = i - 1, j - 1
            path.append((i, j))
        elif here == rows[i - 1, j] + EDIT:
            i -= 1
            path.append((i, -1))
        elif here == rows[i, j - 1] + EDIT:
            j -= 1
            path.append((-1, j))
        elif i - 1 in passage.ends:
            j = int(rows[i, :j].argmax())
        else:
            break
    return path[::-1]


@dataclass
class Hit:
    item: int
    begin: int  # characters of the document (words, as long as no places are known)
    end: int
    span: int  # words of the passage from the first to the last that agrees
    agree: int
    rare: int
    rare_agree: int


def _supported(p: Passage, words: list[str], path: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Runs of the path's parts between foreign sentences, each part with an agreeing rare word; a frame without any joins nothing."""
    parts, seen = [[]], None
    for i, j in path:
        if j >= 0:
            if seen is not None and j > seen + 1:
                parts.append([])
            seen = j
        parts[-1].append((i, j))
    run = []
    for part in parts:
        if any(i >= 0 and j >= 0 and p.own[i] and p.words[i] == words[j] and p.words[i] in p.rare for i, j in part):
            run += part
        elif run:
            yield run
            run = []
    if run:
        yield run


def best_stretch(p: Passage, words: list[str], path: list[tuple[int, int]]) -> Hit | None:
    """The longest stretch of the path that is a hit; see the module's text."""
    hits = [h for run in _supported(p, words, path) if (h := _longest(p, words, run))]
    return max(hits, key=lambda h: (h.span, h.agree)) if hits else None


def _longest(p: Passage, words: list[str], path: list[tuple[int, int]]) -> Hit | None:
    of_passage = np.array([i >= 0 for i, _ in path])
    same = np.array([i >= 0 and j >= 0 and p.words[i] == words[j] for i, j in path])
    own = np.array([i >= 0 and p.own[i] for i, _ in path])
    rare = own & np.array([i >= 0 and p.words[i] in p.rare for i, _ in path])
    total = {k: np.concatenate([[0], np.cumsum(x)]) for k, x in {"span": of_passage, "edit": ~same, "rare": rare, "rare_agree": rare & same, "own": own & same, "agree": same}.items()}
    beside = np.concatenate([same[1:], [False]])
    first = np.flatnonzero(same & (beside | rare))
    last = np.flatnonzero(same & (np.concatenate([[False], same[:-1]]) | rare))
    best = None
    for x in first:
        y = last[last >= x]
        if not len(y) or total["span"][y[-1] + 1] - total["span"][x] < max(LEAST, best[0] if best else 0):
            break  # later beginnings only give shorter stretches
        got = {k: t[y + 1] - t[x] for k, t in total.items()}
        # a single rare word may agree by chance: it must be the stretch's only one, with the full length in agreement in the passage's own sentences
        ok = (got["span"] >= LEAST) & (3 * got["edit"] < got["span"]) & (got["rare_agree"] >= AGREE * got["rare"]) & ((got["rare_agree"] > 1) | ((got["rare"] == 1) & (got["own"] >= LEAST)))
        if ok.any():
            k = np.flatnonzero(ok)[-1]
            if best is None or (got["span"][k], got["agree"][k]) > best[:2]:
                best = (int(got["span"][k]), int(got["agree"][k]), int(x), int(y[k]), int(got["rare"][k]), int(got["rare_agree"][k]))
    if best is None:
        return None
    span, agree, x, y, n_rare, n_agree = best
    return Hit(p.items[0], path[x][1], path[y][1] + 1, span, agree, n_rare, n_agree)


def _windows(at: list[int], n: int) -> Iterator[list[int]]:
    """Runs of places that lie no further apart than the passage and a few foreign sentences, long ones in overlapping parts."""
    run = [at[0]]
    for k in at[1:]:
        if k - run[-1] > n + APART:
            yield run
            run = [k]
        elif k - run[0] > WINDOW * n:
            yield run
            run = [x for x in run if x > k - OVERLAP * n - APART] + [k]
        else:
            run.append(k)
    yield run


def hits_of(p: Passage, ws: list[str], at: Iterable[int]) -> list[Hit]:
    """Every hit of a passage in the words of a text whose n-grams of the passage begin at ``at``; places are words."""
    n, out = len(p.words), {}
    for run in _windows(sorted(set(at)), n):
        lo, hi = max(0, run[0] - n - 8), min(len(ws), run[-1] + n + 10)
        # a stretch that was aligned is blanked and the rest aligned again
        window, left = ws[lo:hi], set(run)
        while left:
            # twelve agreeing words with a single rare one hold twice the pairs at least
            need = PAIRS if sum(w in p.rare for w in window) > 1 else LEAST // 2
            if sum(x in p.pairs for x in zip(window, window[1:])) < need:
                break
            path = align(p, window)
            touched = [j for _, j in path if j >= 0]
            if not touched:
                break
            h = best_stretch(p, window, path)
            b, e = (h.begin, h.end) if h else (min(touched), max(touched) + 1)
            if h:
                out[lo + b, lo + e] = replace(h, begin=lo + b, end=lo + e)
            window[b:e] = [""] * (e - b)
            left = {k for k in left if not b <= k - lo < e}
    return [out[k] for k in sorted(out)]


def _placed(text: str, found: list[tuple[Passage, list[Hit]]], words: Words) -> list[Hit]:
    """Hits with places in characters, one for each item of the passage."""
    at = words.places(text, {k for _, hs in found for h in hs for k in (h.begin, h.end - 1)})
    return [replace(h, item=i, begin=at[h.begin][0], end=at[h.end - 1][1]) for p, hs in found for i in p.items for h in hs]


def find_leaks(text: str, index: Index, words: Words) -> list[Hit]:
    """Every hit of every passage in the text, in the order of the text for each passage."""
    return list(scan([text], index, words))[0]


def scan(texts: Iterable[str], index: Index, words: Words) -> Iterator[list[Hit]]:
    """The hits of each text; the windows of many texts are looked up at once."""
    held, codes, starts = [], [], []

    def flush() -> Iterator[list[Hit]]:
        found: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        if codes:
            c, edges = np.array(codes, dtype=np.uint64), np.array([*starts, len(codes)])
            for gap in (1, 2):
                if len(c) > gap:
                    at, who = index.lookup(pair_hash(c[:-gap], c[gap:]))
                    doc = np.searchsorted(edges, at, "right") - 1
                    for d, k, w in zip(doc.tolist(), at.tolist(), who.tolist()):
                        if k + gap < edges[d + 1]:
                            found[d][w].add(k - int(edges[d]))
        for d, text in enumerate(held):
            got = []
            if d in found:
                ws = words(text)
                got = [(p, hs) for w in sorted(found[d]) if (hs := hits_of(p := index.passages[w], ws, found[d][w]))]
            yield _placed(text, got, words) if got else []

    for text in texts:
        held.append(text)
        starts.append(len(codes))
        codes += words.codes(text)
        if len(codes) >= CHUNK_WORDS:
            yield from flush()
            held, codes, starts = [], [], []
    yield from flush()


OUT = "doc_id long, item_id long, from_char int, to_char int, span_words int, agree_words int, rare_words int, rare_agree int"


def _row(d: int, h: Hit) -> tuple:
    return (d, h.item, h.begin, h.end, h.span, h.agree, h.rare, h.rare_agree)


def leaked_spans(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", broadcast_chars: int = BROADCAST_CHARS
) -> DataFrame:
    """One row for every hit of a passage in a document, with the span of characters it covers.

    A document that holds a passage, or pieces of it, several times has as many rows. Null and empty texts and passages
    give no row; repeated documents give repeated rows; a passage of fewer than twelve words can't be
    found, nor one without a sentence of its own; items with the same words have the same hits, and an
    item that is repeated counts once; in scripts without blanks every character is a word; whole texts
    are read. One pass over the documents without a shuffle, or, where the passages have more than
    ``broadcast_chars`` characters, a join of n-grams and one of candidates.
    """
    src = docs.where(F.length(text) > 0).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    its = items.where(F.length(passage) > 0).select(F.col(item_id).cast("long").alias("item_id"), F.col(passage).alias("passage")).where("item_id is not null")
    if (its.agg(F.sum(F.length("passage"))).first()[0] or 0) > broadcast_chars:
        return _joined_spans(src, its)
    rows = sorted((r.item_id, r.passage) for r in its.distinct().collect())  # bounded by `broadcast_chars`
    index = ship(docs.sparkSession, Index(rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, found = kept("words of leaks", Words), index()
        for b in batches:
            got = [_row(d, h) for d, hits in zip(b["doc_id"], scan(b["text"], found, words)) for h in hits]
            yield pd.DataFrame(got, columns=[c.split()[0] for c in OUT.split(", ")])

    return spread(src, "doc_id").mapInPandas(run, OUT)


def _prepared(items: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``form, text, standing, uncommon, names`` of every passage that can give a hit, and ``form, item_id``; counts are made by Spark over all passages."""

    def forms_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for b in batches:
            yield pd.DataFrame({"item_id": b["item_id"], "text": b["passage"], "key": [" ".join(words(t)) for t in b["passage"]]})

    # of texts with the same words, the one of the lowest item stands for all
    keyed = scratch.stage(items.mapInPandas(forms_of, "item_id long, text string, key string").withColumn("key", F.sha2("key", 256)))
    forms = scratch.stage(keyed.groupBy("key").agg(F.min(F.struct("item_id", "text")).alias("s")).select("key", F.col("s.item_id").alias("form"), F.col("s.text").alias("text")))
    member = keyed.select("key", "item_id").distinct().join(forms.select("key", "form"), "key").select("form", "item_id")
    n = forms.count()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for b in batches:
            rows = []
            for f, t in zip(b["form"], b["text"]):
                held = {}
                for s, ws in sentences(t, words):
                    held.setdefault(ws, s)
                rows += [(f, " ".join(ws), bool(named(s, words))) for ws, s in held.items()]
            yield pd.DataFrame(rows, columns=["form", "sentence", "names"])

    parts = scratch.stage(forms.select("form", "text").mapInPandas(split, "form long, sentence string, names boolean"))
    count = parts.groupBy("sentence").agg(F.count(F.lit(1)).alias("n"), F.max("names").alias("names"))
    standing = count.where(F.col("n") > F.when(F.col("names"), F.lit(few(n))).otherwise(F.lit(1))).select("sentence")
    per_form = parts.join(standing, "sentence").groupBy("form").agg(F.collect_list("sentence").alias("standing"))
    with_standing = scratch.stage(forms.select("form", "text").join(per_form, "form", "left"))

    def word_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for b in batches:
            rows = []
            for f, t, st in zip(b["form"], b["text"], b["standing"]):
                shared = {tuple(s.split(" ")) for s in (st if st is not None else ())}
                if p := make_passage(t, [f], shared, words):
                    names = own_names(t, shared, words)
                    rows += [(f, w, w in names) for w in set(p.words) | names]
            yield pd.DataFrame(rows, columns=["form", "word", "named"])

    ws = scratch.stage(with_standing.mapInPandas(word_rows, "form long, word string, named boolean"))
    usable = ws.select("form").distinct().count()
    held = ws.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.max("named").alias("named")).where(F.col("n") <= few(usable)).select("word", F.col("named").alias("a_name"))
    rare = ws.join(held, "word").groupBy("form").agg(F.collect_list("word").alias("uncommon"), F.collect_list(F.when(F.col("a_name"), F.col("word"))).alias("names"))
    return scratch.stage(with_standing.join(rare, "form")), scratch.stage(member)


def _passage_of(form: int, text: str, standing, uncommon, names, words: Words) -> Passage:
    p = make_passage(text, [form], {tuple(s.split(" ")) for s in (standing if standing is not None else ())}, words)
    set_rare(p, set(uncommon), set(names))
    return p


def _joined_spans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``leaked_spans`` by joins, for passages whose index is too large to be broadcast."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    passages, member = _prepared(items, scratch)

    def seed_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for b in batches:
            got = [seeds(_passage_of(*r, words)).view(np.int64) for r in b[["form", "text", "standing", "uncommon", "names"]].itertuples(index=False)]
            yield pd.DataFrame({"gram": np.concatenate([np.zeros(0, np.int64), *got]), "form": np.repeat(b["form"].to_numpy(), [len(g) for g in got])})

    grams = scratch.stage(passages.mapInPandas(seed_rows, "gram long, form long"))
    # a filter of fixed size: blocks of bytes, put together on the driver
    slot = F.expr(f"shiftrightunsigned(gram, {64 - (FILTER_BITS.bit_length() - 1)})")
    block = 1 << 16

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(block, dtype=np.uint8)
        bits[pdf["slot"].to_numpy() % block] = 1
        return pd.DataFrame({"block": [int(pdf["slot"].iloc[0]) // block], "bits": [np.packbits(bits).tobytes()]})

    packed = grams.select(slot.alias("slot")).distinct().groupBy(F.floor(F.col("slot") / block)).applyInPandas(pack, "block long, bits binary").collect()
    table = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in packed:
        table[r["block"] * block // 8 : (r["block"] + 1) * block // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    shared = ship(spark, table)
    shift = np.uint64(64 - (FILTER_BITS.bit_length() - 1))

    def doc_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, bits = kept("words of leaks", Words), shared()
        for b in batches:
            ids, got = [], []
            for d, t in zip(b["doc_id"], b["text"]):
                c = np.array(words.codes(t), dtype=np.uint64)
                keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *[pair_hash(c[:-g], c[g:]) for g in (1, 2) if len(c) > g]]))
                at = (keys >> shift).astype(np.int64)
                keys = keys[(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0]
                got.append(keys.view(np.int64))
                ids.append(np.full(len(keys), d))
            yield pd.DataFrame({"doc_id": np.concatenate([np.zeros(0, np.int64), *ids]), "gram": np.concatenate([np.zeros(0, np.int64), *got])})

    known = docs.where("doc_id is not null")
    pairs = spread(known, "doc_id").mapInPandas(doc_grams, "doc_id long, gram long").join(grams, "gram").select("doc_id", "form").distinct()
    pairs = scratch.stage(pairs)
    both = known.join(pairs, "doc_id").join(passages.withColumnRenamed("text", "passage"), "form").select("doc_id", "text", "form", "passage", "standing", "uncommon", "names")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = kept("words of leaks", Words)
        for b in batches:
            got = []
            for d, t, *rest in b.itertuples(index=False):
                one = Index(())
                one.passages = [_passage_of(*rest, words)]
                one.post()
                got += [_row(d, h) for h in find_leaks(t, one, words)]
            yield pd.DataFrame(got, columns=[c.split()[0] for c in OUT.split(", ")])

    spans = both.mapInPandas(verify, OUT).withColumnRenamed("item_id", "form")
    return spans.join(member, "form").select(*[c.split()[0] for c in OUT.split(", ")])


def remove_spans(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text`` of the documents with spans, without the characters the spans cover.

    Spans may overlap; what is left on either side is joined by one blank.
    """
    s = spans.groupBy(F.col("doc_id").alias("_d")).agg(F.sort_array(F.collect_set(F.struct("from_char", "to_char"))).alias("_s"))
    both = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(s, F.col("doc_id") == F.col("_d")).select("doc_id", "text", "_s")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for t, cuts in zip(b["text"], b["_s"]):
                left, at = [], 0
                for c in cuts:
                    lo, hi = c["from_char"], c["to_char"]
                    if lo > at:
                        left.append(t[at:lo].rstrip())
                    at = max(at, hi)
                left.append(t[at:].lstrip())
                texts.append(" ".join(k for k in left if k))
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": texts})

    kind = both.schema["doc_id"].dataType.simpleString()
    return both.mapInPandas(run, f"doc_id {kind}, text string")


def cleaned_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """``doc_id, text`` of the documents with hits, without any: what is left after a cut is searched again until nothing is found.

    Identifiers should be unique; of documents that share one all are cut alike.
    """
    scratch = Scratch(docs.sparkSession, "cleaned")
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    spans = scratch.stage(leaked_spans(src, items, **names))
    left, out = src, None
    while not spans.isEmpty():
        # only documents that were cut are searched again
        left = scratch.stage(remove_spans(left, spans))
        out = left if out is None else out.join(left, "doc_id", "left_anti").unionByName(left)
        spans = scratch.stage(leaked_spans(left, items, **names))
    return out if out is not None else src.limit(0)
