"""Packing of token ids into windows with no padding: mixes of lengths by non-negative least squares.

A document's ids, with an end id, are cut into whole windows and a rest. Rests are mixed: all combinations of up to
three lengths that fill a window are enumerated, their repeat counts are solved against the histogram of the rests by
non-negative least squares, rounded down, and what remains is packed greedily; rests that fit nowhere exactly stand in
a line that is cut at each window, and whose last piece is cut into powers of two, so no sequence has to be padded.

The histogram has one number a length, so the driver plans on that alone. Which document takes which place follows
from its rank among those of its length: its place in its task and the counts of the tasks before. A count has one
row a task and length; no id list is ever sorted or shuffled while those fit a broadcast, and beyond it Spark joins.

Defined cases: a null text is an empty one, with the end id alone; null and repeated doc_ids are documents like any
other; texts of any length are encoded whole; the special token's string is the special token, as in the library; an
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelens.llm.mixes import Plan, plan
from cuelens.llm.session import store, worker_imports
from cuelens.llm.textkit import Texts, let_go, slices
from cuelens.llm.wordtable import WordTable, joined, split_spaced

WINDOW, END_ID = 1024, 0
#: Rows of (task, length, count) that are broadcast; beyond them Spark joins as it sees fit.
MOST_COUNTS = 1 << 20
_SPECIAL = "<|endoftext|>"


class Encoder:
    """Byte-level BPE of a ``tokenizers`` file over Arrow batches."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        vocabulary = library.get_vocab(with_added_tokens=True)
        starts = np.zeros(max(vocabulary.values()) + 1, bool)
        starts[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True  # the byte alphabet's blank
        self.table = WordTable(lambda words: joined(library, starts, words))
        self.kind = np.dtype("<u2") if max(vocabulary.values()) < 1 << 16 else np.dtype("<u4")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts' ids, and all ids."""
        own = Texts(texts)
        start, first = split_spaced(own, _SPECIAL.encode())
        count, ids = self.table.encode(own.buf, start, np.append(start, len(own.buf))[1:])
        return np.concatenate([[0], np.cumsum(count)])[first], ids


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """A row a document: part, doc_id, n_tokens, whole (windows of the part's documents before), rest (its length), nth (of that length in the part), wide (bytes an id), ids."""
    worker_imports(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, own = TaskContext.get().partitionId(), encoder(tokenizer)
        before, seen = 0, np.zeros(window, np.int64)
        for batch in slices(batches, "text", 2 << 20):
            off, ids = own.encode(batch.column("text"))
            n = np.diff(off) + 1
            flat = np.empty(len(ids) + len(n), own.kind)
            ends = np.cumsum(n)
            inner = np.ones(len(flat), bool)
            inner[ends - 1] = False
            flat[inner], flat[ends - 1] = ids, END_ID
            whole, rest = n // window, n % window
            order = np.argsort(rest, kind="stable")
            nth = np.empty(len(n), np.int64)
            nth[order] = np.arange(len(n)) - np.searchsorted(rest[order], rest[order])
            raw = pa.py_buffer(flat.tobytes())
            columns = [
                pa.array(np.full(len(n), part, np.int32)), batch.column("doc_id"), pa.array(n), pa.array(before + np.cumsum(whole) - whole), pa.array(rest.astype(np.int32)),
                pa.array(nth + seen[rest]), pa.array(np.full(len(n), own.kind.itemsize, np.int32)),
                pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], ends * own.kind.itemsize]).astype(np.int32).tobytes()), raw]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "n_tokens", "whole", "rest", "nth", "wide", "ids"])
            before += int(whole.sum())
            seen += np.bincount(rest, minlength=window)
        let_go()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "part int, doc_id long, n_tokens long, whole long, rest int, nth long, wide int, ids binary")


def _pieces(how: Plan, rest: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of the rests: row, start in the rest, length, sequence, offset."""
    window = how.window
    # intervals in order of length and rank, so one search finds each rest's
    order = np.lexsort((how.first, how.length))
    length, first, copies, sequence, offset = (np.array(x, np.int64)[order] for x in (how.length, how.first, how.copies, how.sequence, how.offset))
    from_, to = np.searchsorted(length, rest), np.searchsorted(length, rest, "right")
    while (open_ := np.flatnonzero(to - from_ > 1)).size:  # bisect all rests at once
        middle = (from_[open_] + to[open_]) // 2
        late = first[middle] <= rank[open_]
        from_[open_[late]], to[open_[~late]] = middle[late], middle[~late]
    nth, loose = rank - first[from_], copies[from_] == 0
    many = np.maximum(copies[from_], 1)
    row, seq, off = np.arange(len(rest)), sequence[from_] + nth // many, offset[from_] + nth % many * rest
    keep = ~loose
    out = [(row[keep], np.zeros(keep.sum(), np.int64), rest[keep], seq[keep], off[keep])]
    # the line: cut at each window, and its last piece at the powers of two that add up to it
    last, tail = how.line // window, how.line % window
    sizes = [1 << k for k in range(tail.bit_length() - 1, -1, -1) if tail >> k & 1]
    bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    row = row[loose]
    at, todo, done = (offset[from_] + nth * rest)[loose], rest[loose].astype(np.int64), np.zeros(len(row), np.int64)
    while len(row):
        place, inside = at // window, at % window
        short = place == last
        k = np.searchsorted(bounds, inside, "right") - 1 if len(sizes) else np.zeros(len(at), np.int64)
        lower = np.where(short, bounds[np.minimum(k, len(bounds) - 1)], 0)
        upper = np.where(short, bounds[np.minimum(k + 1, len(bounds) - 1)], window)
        size = np.minimum(todo, upper - inside)
        out.append((row, done, size, how.mixed + place + np.where(short, k, 0), inside - lower))
        more = todo > size
        row, at, todo, done = row[more], (at + size)[more], (todo - size)[more], (done + size)[more]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` token_ids."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    tokens = store(encode_documents(docs, tokenizer, window), "packed-tokens")
    counts = store(tokens.groupBy("part", "rest").agg(F.count("*").alias("n"), F.max(F.col("whole") + F.floor(F.col("n_tokens") / window)).alias("whole")), "packed-counts")
    histogram = np.zeros(window, np.int64)
    for rest, n in counts.groupBy("rest").agg(F.sum("n")).collect():
        histogram[rest] = n
    how = plan(histogram, window)
    wholes = sorted(map(tuple, counts.groupBy("part").agg(F.max("whole")).collect()))  # one row a task
    bases = np.cumsum([how.mixed + how.line_windows, *(n for _, n in wholes)]).tolist()
    base = spark.createDataFrame([(p, b) for (p, _), b in zip(wholes, bases, strict=False)], "part int, base long")
    before = F.sum("n").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranks = counts.select("part", "rest", F.coalesce(before, F.lit(0)).alias("before"))
    if len(wholes) * window <= MOST_COUNTS:
        ranks = F.broadcast(ranks)
    placed = tokens.join(ranks, ["part", "rest"]).join(F.broadcast(base), "part")
    rows = placed.select("doc_id", "n_tokens", (F.col("base") + F.col("whole")).alias("whole"), "rest", (F.col("before") + F.col("nth")).alias("rank"), "wide", "ids")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids", 4 << 20):
            n, whole, rest, rank = (batch.column(c).to_numpy() for c in ("n_tokens", "whole", "rest", "rank"))
            kind = np.dtype(f"<u{batch.column('wide')[0].as_py()}")
            flat = np.concatenate([np.frombuffer(x, kind) for x in batch.column("ids").to_pylist()]).astype("<u4")
            begin = np.cumsum(n) - n
            full = n // window
            row = np.repeat(np.arange(len(n)), full)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
            parts = [(row, nth * window, np.full(len(row), window), whole[row] + nth, np.zeros(len(row), np.int64))]
            some = np.flatnonzero(rest)
            if len(some):
                at, start, length, sequence, offset = _pieces(how, rest[some].astype(np.int64), rank[some])
                parts.append((some[at], full[some[at]] * window + start, length, sequence, offset))
            row, start, length, sequence, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((start, row))
            row, start, length, sequence, offset = (x[order] for x in (row, start, length, sequence, offset))
            place = begin[row] + start
            view = memoryview(flat).cast("B")
            crc = [crc32(view[4 * a : 4 * (a + b)]) for a, b in zip(place.tolist(), length.tolist(), strict=True)]
            columns = [batch.column("doc_id").take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, crc, n[row], sequence, offset))]
            if with_ids:  # pieces in order of document and start lie in the ids one after the other
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(place, len(flat)), pa.int32()), pa.array(flat.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names + ["token_ids"] * with_ids)

    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", token_ids array<int>" * with_ids)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """A row a sequence: sequence_id, token_ids, and its pieces as array of (offset, doc_id, start, length); padded to the window but at a power of two."""
    own = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "token_ids"))).alias("own"))
    ids = F.flatten(F.col("own.token_ids"))
    size = F.size(ids)
    power = F.bit_count(size) == 1
    return own.select(
        "sequence_id",
        F.when(power, ids).otherwise(F.concat(ids, F.array_repeat(F.lit(pad_id), F.lit(window) - size))).alias("token_ids"),
        F.transform("own", lambda x: F.struct(x["offset"].alias("offset"), x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length"))).alias("pieces"),
    )


def packing_digest(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    return pack(docs, with_ids=False)
