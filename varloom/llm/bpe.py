"""Byte-level BPE as a lazily determinised finite-state transducer.

A vocabulary of byte-pair merges has this property: a sequence of tokens is the encoding of its
bytes if and only if every two neighbours are the encoding of theirs. So the last token of every
prefix is fixed by the prefix alone, and the encoding of a text can be read left to right: at each
position several token starts are still *alive* (their bytes so far begin some token of the
vocabulary), each with the chain of tokens that leads to it. Tokens that all chains share can no
longer change and are emitted; no token is longer than the vocabulary's longest, so the lookahead is
bounded. A state is the set of live starts with their chains after the last emitted token. States
and transitions are made when a text first needs them and then looked up; the cache is emptied when
it is full, which changes nothing in the result.

Decoding is a stream as well: a UTF-8 state machine turns the tokens' bytes into characters as
soon as they are complete.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ..session import kept, spread

#: Fixed value: the pattern that cuts a text into the units within which bytes are merged.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same for texts of ASCII characters only, which the standard library matches faster.
ASCII_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""

#: Where the public vocabularies are; every function takes another path.
TOKENIZERS = "/opt/tokenizers"
#: States of the transducer and units with their ids that a worker keeps, and the longest unit that is kept.
MAX_STATES, MAX_UNITS, LONGEST_UNIT = 120_000, 200_000, 64
#: Units of a text whose ids are put together at once.
MOST_AT_ONCE = 50_000
#: A vocabulary file above this many bytes is refused, as it is sent to every worker.
MAX_FILE = 32 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a ``.tiktoken`` file (ids are merge ranks)."""
    with open(path, "rb") as f:
        data = f.read(MAX_FILE + 1)
    if len(data) > MAX_FILE:
        raise ValueError(f"{path} is larger than {MAX_FILE} bytes")
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Transducer:
    """Encodes byte strings; see the module's text."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        # the trie of the vocabulary: (node, byte) -> node, and each node's token or -1
        self.child: dict[int, int] = {}
        self.token = [-1]
        for token, i in ranks.items():
            node = 0
            for byte in token:
                to = self.child.get(node << 8 | byte)
                if to is None:
                    to = self.child[node << 8 | byte] = len(self.token)
                    self.token.append(-1)
                node = to
            self.token[node] = i
        self.bytes_of = {i: t for t, i in ranks.items()}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self._pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = (0, (-1,))  # a trie node and the chain of tokens before it, for every live start
        self.states: list[tuple] = [start]
        self.index: dict[tuple, int] = {start: 0}
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def _merge(self, data: bytes) -> list[bytes]:
        """The encoding by definition: always merge the leftmost pair of lowest rank. Only for pairs of tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank, none = self.ranks.get, 1 << 60
        ranks = [rank(x + y, none) for x, y in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], none)
        return parts

    def _stay(self, a: int, b: int) -> bool:
        """Whether two tokens side by side are the encoding of their bytes; -1 is the start of the text."""
        if a < 0:
            t = self.bytes_of[b]
            key = (-1, b)
            if key not in self._pairs:
                self._pairs[key] = len(self._merge(t)) == 1
            return self._pairs[key]
        key = (a, b)
        if (known := self._pairs.get(key)) is None:
            if len(self._pairs) > 500_000:
                self._pairs.clear()
            x, y = self.bytes_of[a], self.bytes_of[b]
            known = self._pairs[key] = self._merge(x + y) == [x, y]
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        now, child, token_of, pairs = self.states[state], self.child, self.token, self._pairs
        key, chains, last = [], [], None
        for k in range(0, len(now), 2):
            node = child.get(now[k] << 8 | byte)
            if node is None:
                continue
            chain = now[k + 1]
            key.append(node)
            chains.append(chain)
            if last is None and (token := token_of[node]) >= 0:
                stays = pairs.get((chain[-1], token))
                if self._stay(chain[-1], token) if stays is None else stays:
                    last = (*chain, token)
        key.append(0)
        chains.append(last)
        # what all chains share is settled; the last settled token stays as context for its neighbour
        first = chains[0]
        most, shared = min(map(len, chains)), 1  # all begin with the same token
        while shared < most:
            token = first[shared]
            for chain in chains:
                if chain[shared] != token:
                    break
            else:
                shared += 1
                continue
            break
        out = first[1:shared]
        key = tuple([x for n, c in zip(key, chains) for x in (n, c[shared - 1 :])])
        to = self.index.get(key)
        if to is None:
            to = self.index[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        move = self.moves[state][byte] = (to, out)
        return move

    def encode(self, data: bytes, into: array) -> None:
        """Append the ids of ``data`` to ``into``."""
        if len(self.states) > self.max_states:
            self._reset()
        state, moves = 0, self.moves
        for n, byte in enumerate(data):
            move = moves[state].get(byte)
            if move is None:
                if len(self.states) > 2 * self.max_states:  # within one very long unit
                    key = self.states[state]
                    self._reset()
                    moves = self.moves
                    if key not in self.index:
                        self.index[key] = len(self.states)
                        self.states.append(key)
                        self.moves.append({})
                    state = self.index[key]
                move = self._step(state, byte)
            state, out = move
            if out:
                into.extend(out)
        into.extend(self.states[state][-1][1:])


class _Units(dict):
    """Ids of the units of texts, made when first asked for; long units are not kept."""

    def __init__(self, fst: Transducer):
        super().__init__()
        self.fst = fst

    def __missing__(self, unit: str) -> array:
        ids = array("i")
        self.fst.encode(unit.encode("utf-8"), ids)
        if len(unit) <= LONGEST_UNIT:
            self[unit] = ids
        return ids


class Encoder:
    """Texts to ids: the units of ``PATTERN``, each through the transducer; short units are remembered, up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, max_states: int = MAX_STATES, max_units: int = MAX_UNITS):
        self.fst, self.max_units = Transducer(ranks, max_states), max_units
        self.units = _Units(self.fst)
        self.cut = regex.compile(pattern).findall
        self.cut_ascii = re.compile(ASCII_PATTERN, re.ASCII).findall if pattern == PATTERN else self.cut

    def encode(self, text: str | None, into: array | None = None) -> array:
        """The ids; null and empty texts have none. Special tokens' strings are ordinary text."""
        out = array("i") if into is None else into
        if not text:
            return out
        if len(self.units) >= self.max_units:
            self.units.clear()
        parts = (self.cut_ascii if text.isascii() else self.cut)(text)
        if len(parts) <= MOST_AT_ONCE:
            out.frombytes(b"".join(map(self.units.__getitem__, parts)))
        else:  # a very long text, in pieces, so that units that are not kept do not pile up
            for i in range(0, len(parts), MOST_AT_ONCE):
                if len(self.units) >= self.max_units:
                    self.units.clear()
                out.frombytes(b"".join(map(self.units.__getitem__, parts[i : i + MOST_AT_ONCE])))
        return out


class Utf8Machine:
    """Incremental UTF-8: ``feed`` returns the characters complete so far, ``close`` the rest.

    Ill-formed input gives U+FFFD for each maximal part that begins a character but can't be one.
    """

    def __init__(self) -> None:
        self.need, self.low, self.high, self.code = 0, 0x80, 0xBF, 0

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.code = self.code << 6 | b & 0x3F
                    self.need -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.need:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.need, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.need, self.code = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.need, self.code = 2, b & 0x0F
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.need, self.code = 3, b & 0x07
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        cut, self.need = self.need, 0
        return "�" if cut else ""


def decode(ids: Iterable[int], bytes_of: dict[int, bytes]) -> str:
    """The text of a list of ids; ids outside the vocabulary give nothing."""
    machine = Utf8Machine()
    return "".join([machine.feed(bytes_of.get(i, b"")) for i in ids]) + machine.close()


def encode_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id, ids array<int>``: every text by a byte-level vocabulary, without special tokens.

    Null and empty texts give an empty list; repeated rows give repeated rows; texts of any length
    are read whole, with memory for the text and its ids. One pass in Arrow batches, no shuffle
    where the scan has a task for every core. The vocabulary (at most ``MAX_FILE`` bytes) is broadcast.
    """
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(f"{folder}/{vocabulary}.tiktoken"))
    src = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = kept(f"bpe {folder}/{vocabulary}", lambda: Encoder(ranks.value))
        for b in batches:
            ids, offsets = array("i"), array("i", [0])
            for t in b.column(1):
                enc.encode(t.as_py(), ids)
                offsets.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "ids"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return spread(src, "doc_id").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_ids(df: DataFrame, doc_id: str = "doc_id", ids: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id, text``: lists of ids back to texts; null and empty lists give an empty text."""
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(f"{folder}/{vocabulary}.tiktoken"))
    src = df.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = kept(f"bytes {folder}/{vocabulary}", lambda: {i: t for t, i in ranks.value.items()})
        for b in batches:
            texts = [decode(x.as_py() or (), bytes_of) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, text string")
