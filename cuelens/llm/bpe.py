"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words.

Every match of the split pattern is a word. A process keeps the words it has met with their ids
(``wordtable``), so a word is merged once and not once an occurrence; the words of a batch that are new are merged
together, as a matrix of token ids in which every row takes its leftmost pair of lowest rank at each
step. Words too long for the matrix are merged with a heap. Decoding joins the tokens' bytes.

A rank map of 50,000 entries as a Spark literal is searched entry by entry, and giving the ids of
distinct words back to their texts inside Spark means shuffling every occurrence; README.md has the
figures. So the fold runs in numpy beside the text and nothing is shuffled.

Defined cases: a null text is an empty one and has no ids; rows that repeat are encoded alike; text
of any length is encoded whole; special tokens' strings are ordinary text; columns other than doc_id
and text are ignored by ``bpe_digest`` and kept by ``encode``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from cuelens.llm.session import worker_imports
from cuelens.llm.textkit import Texts, let_go, slices
from cuelens.llm.wordtable import WordTable, split_spaced

#: Bytes of the longest word that is merged in the matrix.
MATRIX_BYTES = 32
#: Words that a task keeps; beyond them it starts anew.
MEMORY_WORDS = 1 << 18
_NONE = np.int32(np.iinfo(np.int32).max)


class Merges:
    """Pair of token ids -> id of their join, which is its rank, in an open hash table for numpy."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pieces: dict[int, bytes] = {v: k for k, v in ranks.items()}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the ranks lack the bytes {missing[:5]}")
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs = pairs
        bits = max(4, (2 * len(pairs)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, _NONE, np.int32)
        key = np.array([a << 32 | b for a, b in pairs], np.int64)
        value = np.array(list(pairs.values()), np.int32)
        at = self._slot(key)
        while len(key):
            free = self.keys[at] == -1
            first = np.zeros(len(key), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = key[put], value[put]
            key, value, at = key[~put], value[~put], (at[~put] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's join, or a number above all ranks."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        key[(left < 0) | (right < 0)] = -2
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], _NONE)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def fold(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word: merge the leftmost pair of lowest rank until no pair has a rank."""
        out: list[tuple[int, ...]] = [()] * len(words)
        rows = []
        for i, w in enumerate(words):
            if (whole := self.ranks.get(w)) is not None:
                out[i] = (whole,)
            elif len(w) > MATRIX_BYTES:
                out[i] = self.long(w)
            elif w:
                rows.append(i)
        for lo, hi in ((1, 8), (9, 16), (17, MATRIX_BYTES)):
            group = [i for i in rows if lo <= len(words[i]) <= hi]
            for k in range(0, len(group), 1 << 16):
                part = group[k : k + (1 << 16)]
                for i, ids in zip(part, self._matrix([words[i] for i in part], hi), strict=True):
                    out[i] = ids
        return out

    def _matrix(self, words: list[bytes], wide: int) -> list[tuple[int, ...]]:
        size = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(-1, wide)
        ids = np.where(np.arange(wide) < size[:, None], self.bytes[raw], np.int32(-1)).astype(np.int32)
        rank = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, wide - 1)
        live = np.arange(len(words))
        column = np.arange(wide - 1)
        while True:
            at = rank[live].argmin(1)
            best = rank[live, at]
            go = best != _NONE
            live, at, best = live[go], at[go], best[go]
            if not len(live):
                return [tuple(row[row >= 0].tolist()) for row in ids]
            after = column > at[:, None]  # drop the pair's right token: all behind it move up by one
            moved = ids[live]
            moved[:, 1:-1] = np.where(after[:, 1:], moved[:, 2:], moved[:, 1:-1])
            moved[np.arange(len(live)), at] = best
            last = at == wide - 2
            moved[:, -1] = -1
            ids[live] = moved
            r = rank[live]
            r[:, :-1] = np.where(column[:-1] >= at[:, None], r[:, 1:], r[:, :-1])
            r[:, -1] = _NONE
            n = np.arange(len(live))
            right = np.where(last, -1, moved[n, np.minimum(at + 1, wide - 1)])
            r[n, at] = self.rank(best, right)
            has = at > 0
            r[n[has], at[has] - 1] = self.rank(moved[n[has], at[has] - 1], best[has])
            rank[live] = r

    def long(self, word: bytes) -> tuple[int, ...]:
        """The same fold with a heap and links, for words of any length."""
        ids = self.bytes[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        get = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (x := get((r, ids[k]))) is not None:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            if (h := left[i]) >= 0 and (x := get((ids[h], r))) is not None:
                heapq.heappush(heap, (x, h, ids[h], r))
        return tuple(x for x in ids if x >= 0)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Encoder:
    """Splits texts by the pattern and encodes them, remembering words."""

    def __init__(self, path: str, pattern: str):
        import public_tokenizers
        import regex

        self.merges = Merges(read_ranks(path))
        self.in_bytes = pattern == public_tokenizers.PATTERN
        self.split = regex.compile(pattern).findall
        self.table = WordTable(self._fold, MEMORY_WORDS)
        self.pieces = np.array([len(self.merges.pieces.get(i, b"")) for i in range(max(self.merges.pieces) + 1)], np.int64)
        self.ends = np.cumsum(self.pieces)
        self.bytes = np.frombuffer(b"".join(self.merges.pieces.get(i, b"") for i in range(len(self.pieces))), np.uint8)

    def _fold(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.merges.fold(words)
        return np.array([len(x) for x in ids], np.int64), np.array([i for x in ids for i in x], np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts' ids, and all ids. The public pattern is found in the bytes, any other by the regex library."""
        own = Texts(texts)
        if self.in_bytes:
            start, first = split_spaced(own)
        else:
            size = [[len(w.encode()) for w in self.split(t or "")] for t in texts.to_pylist()]
            if [sum(x) for x in size] != np.diff(own.off).tolist():
                raise ValueError("the pattern leaves characters out")
            flat = np.array([n for x in size for n in x], np.int64)
            start, first = np.cumsum(flat) - flat, np.concatenate([[0], np.cumsum([len(x) for x in size])]).astype(np.int64)
        count, ids = self.table.encode(own.buf, start, np.append(start, len(own.buf))[1:])
        return np.concatenate([[0], np.cumsum(count)])[first], ids

    def decode(self, off: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts' bytes, and all bytes: the ids' pieces joined."""
        size = self.pieces[ids]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        return np.concatenate([[0], stop])[off], self.bytes[np.repeat(self.ends[ids] - size - (stop - size), size) + np.arange(total)]


@cache
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with two columns more, or anew: ``token_ids`` array<int> and ``decoded``, the binary join of their pieces."""
    worker_imports(docs.sparkSession)
    path, pattern = _defaults(path, pattern)
    names = [c for c in docs.columns if c not in ("token_ids", "decoded")]
    rows = docs.select(*names)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in slices(batches, "text", 2 << 20):
            off, ids = own.encode(batch.column(at))
            place, data = own.decode(off, ids)
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int32)))
            decoded = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(place.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, decoded], [*names, "token_ids", "decoded"])
        let_go()

    more = [StructField("token_ids", ArrayType(IntegerType())), StructField("decoded", BinaryType())]
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *more]))


def bpe_digest(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    worker_imports(docs.sparkSession)
    path, pattern = _defaults(path, pattern)
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in slices(batches, "text", 2 << 20):
            off, ids = own.encode(batch.column("text"))
            place, data = own.decode(off, ids)
            sha = lambda raw, at: pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())
            columns = [batch.column("doc_id"), pa.array(np.diff(off), pa.int64()), sha(memoryview(ids.astype("<u4")).cast("B"), 4 * off), sha(memoryview(np.ascontiguousarray(data)).cast("B"), place)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        let_go()

    return rows.mapInArrow(run, rows.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string"))
