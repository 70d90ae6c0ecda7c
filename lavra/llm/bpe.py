"""Byte-level BPE by merge replay over a corpus of words.

The distinct words (matches of the splitting pattern) of many texts are laid out as one row of symbols. An inverted
index holds, for each pair of neighbouring symbols, the positions where it stands; a heap gives the pairs in rank
order. Each merge is applied at all its positions at once, left to right, and only the pairs to either side of a merged
position change in the index: pairs of low rank, which stand at many positions, as arrays, the others one position
after the other. A word's ids are then remembered (a bounded number of words in a worker) and texts are put together
from them.

Null texts read as empty and have no ids. Repeated rows give repeated results; very long texts are encoded whole. An
empty table gives an empty result. Only the id and text columns are read."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
import sys
import unicodedata
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavra.llm.batches import pieces, texts

WORDS = 500_000  # words a worker remembers
GROUP = 50_000  # words that are merged together
PIECE = 2 << 20  # bytes of text whose words are gathered at a time
COMMON = 10_000  # ranks whose merges go by arrays
# The characters of the Unicode property White_Space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _ranges(first: str) -> str:
    """Characters of the general categories that begin with `first`, as ranges for a character class of `re`."""
    out, start = [], None
    for code in range(sys.maxunicode + 2):
        inside = code <= sys.maxunicode and unicodedata.category(chr(code))[0] == first
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(out)


def _compiled(letter: str, number: str, space: str) -> re.Pattern:
    """public_tokenizers.PATTERN for `re`, which knows no properties: its classes are spelt out as ranges."""
    pattern = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]")
    return re.compile(pattern.replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))


@functools.lru_cache(1)
def _splitters() -> tuple[re.Pattern, re.Pattern]:
    """For texts of Latin-1 characters, whose classes `re` looks up in one small table, and for all texts."""
    letter, number = _ranges("L"), _ranges("N")
    latin = ["".join(f"\\x{ord(c):02x}" for c in map(chr, range(256)) if re.match(f"[{x}]", c)) for x in (letter, number, SPACE)]
    return _compiled(*latin), _compiled(letter, number, SPACE)


def split(text: str) -> list[str]:
    """The matches of public_tokenizers.PATTERN, in order."""
    latin, every = _splitters()
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return every.findall(text)
    return latin.findall(text)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


class Words(dict):
    """Places of words, in the order in which they were first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        out = self[word] = len(self)
        self.new.append(word)
        return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each of many runs, one run behind the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Store:
    """The ids of words by their places: those of word n stand at bounds[n] .. bounds[n + 1]."""

    def __init__(self):
        self.words, self.flat, self.bounds, self.have = Words(), np.empty(1 << 16, np.int32), np.zeros(1 << 12, np.int64), 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, at = self.have, int(self.bounds[self.have])
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while n + len(sizes) >= len(self.bounds):
            self.bounds = np.concatenate((self.bounds, np.zeros_like(self.bounds)))
        self.flat[at : at + len(ids)] = ids
        self.bounds[n + 1 : n + 1 + len(sizes)] = at + np.cumsum(sizes)
        self.have = n + len(sizes)

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these words, one after the other; how many each has)."""
        starts = self.bounds[places]
        sizes = self.bounds[places + 1] - starts
        return self.flat[spread(starts, sizes)], sizes


class Replay:
    """Ids of words by the ranks of a file. `path` is read where the words are encoded."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.sizes = np.array([len(x) for x in self.pieces], np.int64)
        self.bytes_of, self.numeral_of = pa.array(self.pieces, pa.large_binary()), pa.array([f" {i}" for i in range(len(self.pieces))], pa.large_binary())
        self.roots = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.joins: dict[int, int] = {}  # left << 17 | right: the merged symbol, or -1
        self.known, self.before = Store(), Store()  # `before`: what was known when `known` last grew full

    def _rank(self, pair: int) -> int:
        if len(self.joins) > 500_000:
            self.joins.clear()
        out = self.joins[pair] = self.ranks.get(self.pieces[pair >> 17] + self.pieces[pair & 0x1FFFF], -1)
        return out

    def _indexed(self, keys: np.ndarray, places: np.ndarray, least: int = 0):
        """(rank, pair, positions) of each pair of `keys` that has a rank, `least` or higher."""
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        joins, rank = self.joins, self._rank
        for pair, a, b in zip(keys[cuts[:-1]].tolist(), cuts.tolist(), cuts[1:].tolist()):
            if (new := joins[pair] if pair in joins else rank(pair)) >= least:
                yield new, pair, places[a:b]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has), all words merged together."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1)
        row = np.full(int(ends[-1]) + 2, -1, np.int64)
        row[1 : 1 + int(ends[-1])] = self.roots[np.frombuffer(b"\0".join(words) + b"\0", np.uint8)]
        row[ends] = -1
        after, before = np.arange(1, len(row) + 1), np.arange(-1, len(row) - 1)
        self._common(row, after, before)
        done = self._rare(row, after, before)
        return done[done >= 0], np.diff(np.cumsum(done >= 0)[ends], prepend=0)

    def _common(self, row: np.ndarray, after: np.ndarray, before: np.ndarray) -> None:
        """Merges of the first `COMMON` ranks. These pairs stand at many positions: each merge is one step over arrays."""
        at = np.flatnonzero((row[:-1] >= 0) & (row[1:] >= 0))
        index: dict[int, list[np.ndarray]] = {}
        heap: list[tuple[int, int]] = []

        def add(keys: np.ndarray, places: np.ndarray) -> None:
            for new, pair, held in self._indexed(keys, places):
                if new >= COMMON:
                    continue
                if pair in index:
                    index[pair].append(held)
                else:
                    index[pair] = [held]
                    heapq.heappush(heap, (new, pair))

        add(row[at] << 17 | row[at + 1], at)
        while heap:
            new, pair = heapq.heappop(heap)
            left, right = pair >> 17, pair & 0x1FFFF
            at = np.concatenate(index.pop(pair))
            at = np.unique(at[(row[at] == left) & (row[after[at]] == right)])
            if left == right and len(at) > 1:  # in a run of one symbol every other position counts, from the left
                run = np.cumsum(np.concatenate(([True], before[at[1:]] != at[:-1])))
                place = np.arange(len(at))
                at = at[(place - place[np.searchsorted(run, run)]) % 2 == 0]
            if not len(at):
                continue
            next_ = after[at]
            row[at], row[next_] = new, -2
            beyond = after[next_]
            after[at], before[beyond] = beyond, at
            ahead = before[at]
            a, b = row[ahead], row[beyond]
            keys, places = np.concatenate((a << 17 | new, new << 17 | b)), np.concatenate((ahead, at))
            real = np.concatenate((a, b)) >= 0
            if real.any():
                add(keys[real], places[real])

    def _rare(self, row: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The other merges, position by position."""
        at = np.flatnonzero(row >= 0)
        at = at[row[after[at]] >= 0]
        index: dict[int, list[int]] = {}
        heap: list[tuple[int, int]] = []
        for new, pair, held in self._indexed(row[at] << 17 | row[after[at]], at):
            index[pair] = held.tolist()
            heap.append((new, pair))
        heapq.heapify(heap)
        row, after, before = row.tolist(), after.tolist(), before.tolist()
        joins, rank, look, push = self.joins, self._rank, index.get, heapq.heappush
        while heap:
            new, pair = heapq.heappop(heap)
            left, right = pair >> 17, pair & 0x1FFFF
            held = index.pop(pair)
            held.sort()
            for at in held:
                if row[at] != left or row[next_ := after[at]] != right:
                    continue  # an earlier merge took one of the two
                row[at], row[next_] = new, -2
                beyond, ahead = after[next_], before[at]
                after[at], before[beyond] = beyond, at
                if (other := row[ahead]) >= 0:
                    made = other << 17 | new
                    if (there := look(made)) is not None:
                        there.append(ahead)
                    elif (r := joins[made] if made in joins else rank(made)) >= 0:
                        index[made] = [ahead]
                        push(heap, (r, made))
                if (other := row[beyond]) >= 0:
                    made = new << 17 | other
                    if (there := look(made)) is not None:
                        there.append(at)
                    elif (r := joins[made] if made in joins else rank(made)) >= 0:
                        index[made] = [at]
                        push(heap, (r, made))
        return np.array(row, np.int64)

    def learn(self, words: list[str]) -> None:
        """Puts the ids of these words behind those that are known."""
        old, whole = self.before.words, self.ranks
        places = np.fromiter((old.get(w, -1) for w in words), np.int64, len(words))
        data = [w.encode() for w in words]
        ranks = np.fromiter((whole.get(d, -1) for d in data), np.int64, len(words))
        rest = np.flatnonzero((places < 0) & (ranks < 0))
        sizes = np.ones(len(words), np.int64)
        parts, order = [ranks[ranks >= 0]], [np.flatnonzero(ranks >= 0)]
        seen = np.flatnonzero((places >= 0) & (ranks < 0))
        for own, (ids, many) in [(seen, self.before.take(places[seen]))] + [(some, self.replay([data[i] for i in some])) for some in np.split(rest, range(GROUP, len(rest), GROUP)) if len(some)]:
            parts.append(ids)
            order.append(own)
            sizes[own] = many
        # What came by kind goes back to the order of the words.
        order, flat = np.concatenate(order), np.concatenate(parts)
        starts = np.empty(len(words), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        self.known.add(flat[spread(starts, sizes)], sizes)

    def encode_all(self, many: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; where each text's begin, and the end)."""
        if len(self.known.words) > WORDS // 2:  # those unused since the last such time are forgotten
            self.before, self.known = self.known, Store()
        words = self.known.words
        parts = [split(text) for text in many]
        places = np.fromiter(map(words.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
        new, words.new = words.new, []
        if new:
            self.learn(new)
        ids, sizes = self.known.take(places)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return ids, ends[np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))]

    def encode(self, many: list[str]) -> list[list[int]]:
        """The ids of each text."""
        ids, bounds = self.encode_all(many)
        return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]

    def joined(self, form: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
        """For each text what stands in `form` for its ids, one behind the other."""
        got = form.take(pa.array(ids))
        at = np.frombuffer(got.buffers()[1], np.int64)[bounds].tolist()
        data = memoryview(got.buffers()[2] or b"")
        return [data[a:b] for a, b in zip(at, at[1:])]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@functools.lru_cache(2)
def replayer(path: str) -> Replay:
    return Replay(load_ranks(path))


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row: the whole text encoded, and its ids decoded again.
    `path` is a rank file that executors can read; by default each finds its own copy of the public one."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        tool = replayer(path or default_path())
        for piece in pieces(batches, most=PIECE):
            ids, bounds = tool.encode_all(texts(piece))
            said = [hashlib.sha256(x[1:]).hexdigest() for x in tool.joined(tool.numeral_of, ids, bounds)]
            back = [hashlib.sha256(x).hexdigest() for x in tool.joined(tool.bytes_of, ids, bounds)]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(bounds)), pa.array(said, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {DIGEST}")


def encoded(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """All columns of `docs` and `token_ids` (array<int>, empty for null texts); a column of that name is replaced."""
    docs = docs.drop("token_ids")

    def run(batches):
        tool = replayer(path or default_path())
        for piece in pieces(batches, text_col, PIECE):
            ids, bounds = tool.encode_all(texts(piece, text_col))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*piece.columns, lists], [*piece.schema.names, "token_ids"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))]))
