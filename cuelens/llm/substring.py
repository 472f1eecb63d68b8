"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Every window of ``width`` words has two independent Rabin-Karp hashes: one names its bucket, the other, of 64 bits,
the window there. A map task first settles what repeats within its own batch and then sends one hash for each
distinct window to the window's bucket, so a passage that a third of all rows share costs one hash a batch, not one
a row. What a batch sends to a bucket is one record, and only buckets that get something have one: records are
never more than windows. A bucket counts its hashes and sends the places of repeated ones back to their batch,
where they merge into maximal removal intervals. Buckets follow the size of the input in number, and up to
``MOST_BUCKET_BYTES`` in size. Documents that lose nothing are not shuffled while a bit set of bounded size can
tell them (``bits``).

Two different windows are taken for one when both hashes agree. With n windows and b a bucket that happens to
about n*b / 2**65 pairs: a few in 10**13 windows.

Batches are named by partition and position, so ``docs`` that Spark may deliver in another order when a task is run
again are stored first (``steady``).

Defined cases: a null text has no words; texts of fewer than ``width`` words lose nothing;
rows that repeat (the same id and text) are separate documents, so they remove each other; a
null doc_id is an id like any other; an empty table gives no rows; other columns, of any name, are kept by
``dedup_substrings`` and ignored by ``substring_digest``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelens.llm.bits import bit_table, split
from cuelens.llm.session import grown, parts_for, steady, store, worker_imports
from cuelens.llm.textkit import Texts, Words, let_go, slices, windows

WIDTH = 35
#: Stored input for one bucket, about a million windows, and at most; a map batch is twice as large, raw.
BUCKET_BYTES, MOST_BUCKET_BYTES = 4 << 20, 16 << 20
#: Text hashed at a time.
HASHED_BYTES = 1 << 20
#: A record with fewer windows is not compressed.
FEW = 64

_SENT = "batch string, bucket int, places binary, hashes binary, settled binary, keys binary, marked binary"


def _pack(sorted_places: np.ndarray) -> bytes:
    """Ascending word positions: few of them plain, many as differences, byte planes apart, compressed; the first byte tells."""
    if len(sorted_places) < FEW:
        return b"\0" + sorted_places.astype("<u4").tobytes()
    steps = np.diff(sorted_places, prepend=0).astype("<u4")
    return b"\1" + zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    if data[0] == 0:
        return np.frombuffer(data, "<u4", offset=1).astype(np.int64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64))


def _runs(home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of buckets: the order that brings equal ones together, the buckets that occur, and each one's start in that order, ended by the length."""
    order = np.argsort(home, kind="stable")
    ordered = home[order]
    edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])) if len(home) else np.zeros(1, np.int64)
    return order, ordered[edge[:-1]], edge


def _hashed(batch: pa.RecordBatch, width: int, buckets: int) -> tuple[np.ndarray, ...]:
    """All windows of a batch: hash, place and bucket, and each text's first word; ``HASHED_BYTES`` of text at a time."""
    parts, done = [], 0
    for some in slices([batch], "text", HASHED_BYTES):
        words = Texts(some.column("text")).words()
        of_words = words.hashes()
        hashes, at = windows(words, of_words, width)
        where = (windows(words, of_words, width, family=1)[0] >> np.uint64(33)) % np.uint64(buckets)
        parts.append((hashes, at + done, where.astype(np.int32), words.first[:-1] + done))
        done += len(words.start)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _send(width: int, buckets: int, batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, batch in enumerate(slices(batches, "text", batch_bytes)):
            hashes, at, where, first = _hashed(batch, width, buckets)
            order = np.argsort(hashes, kind="stable")
            ordered = hashes[order]
            again = np.zeros(len(ordered), bool)
            again[1:] = ordered[1:] == ordered[:-1]
            repeats = again.copy()
            repeats[:-1] |= again[1:]
            marked = np.sort(at[order[repeats]])
            known = order[repeats & ~again]
            single = np.sort(order[~repeats])
            name, rows = f"{part}-{k}", {c: [] for c in ("bucket", "places", "hashes", "settled", "keys", "marked")}
            for chosen, settled in ((single, False), (known, True)):
                by, of, edge = _runs(where[chosen])
                mine, places = hashes[chosen][by], at[chosen][by]
                for b, lo, hi in zip(of.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    sent = mine[lo:hi].tobytes()
                    for c, v in zip(rows, (b, None, None, sent, None, None) if settled else (b, _pack(places[lo:hi]), sent, None, None, None), strict=True):
                        rows[c].append(v)
            keys = pa.table({"first": first, "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash")})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, keys.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(keys)
            extra = (abs(hash((part, k))) % buckets, None, None, None, sink.getvalue().to_pybytes(), _pack(marked))
            for c, v in zip(rows, extra, strict=True):
                rows[c].append(v)
            kinds = (pa.int32(), *[pa.binary()] * 5)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(rows["bucket"])), *(pa.array(rows[c], t) for c, t in zip(rows, kinds, strict=True))], ["batch", *rows]
            )
        let_go()

    return run


def _count(table: pa.Table) -> pa.Table:
    """Of one bucket: the places whose hash came more than once, by batch; keys and marks pass through."""
    passed = table.filter(pc.is_valid(table["keys"]))
    sent = table.filter(pc.is_null(table["keys"]))
    found: dict[str, bytes] = {}
    if sent.num_rows:
        single = sent.filter(pc.is_valid(sent["places"]))
        names = single["batch"].to_pylist()
        alone = [np.frombuffer(x.as_buffer(), "<u8") for x in single["hashes"]]
        settled = [np.frombuffer(x.as_buffer(), "<u8") for x in sent.filter(pc.is_valid(sent["settled"]))["settled"]]
        edge = np.cumsum([0, *map(len, alone)])
        every = np.concatenate([*alone, *settled])
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        same = ordered[1:] == ordered[:-1]
        hit = np.zeros(len(every), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        for i, name in enumerate(names):
            if (mine := hit[edge[i] : edge[i + 1]]).any():
                found[name] = _pack(_unpack(single["places"][i].as_py())[mine])
    return pa.table(
        {
            "batch": pa.array([*passed["batch"].to_pylist(), *found], pa.string()),
            "keys": pa.array([*passed["keys"].to_pylist(), *[None] * len(found)], pa.binary()),
            "marked": pa.array([*passed["marked"].to_pylist(), *found.values()], pa.binary()),
        }
    )


def _merge(width: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one batch: for each document that loses words, its maximal removal intervals."""
        keys = pa.ipc.open_stream(next(x for x in table["keys"].to_pylist() if x is not None)).read_all()
        starts = np.unique(np.concatenate([_unpack(x.as_py()) for x in table["marked"]]))
        first = keys["first"].to_numpy()
        owner = np.searchsorted(first, starts, "right") - 1
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (starts[1:] > starts[:-1] + width) | (owner[1:] != owner[:-1])
        lo = starts[fresh]
        last = np.append(np.flatnonzero(fresh)[1:] - 1, len(starts) - 1) if len(starts) else np.zeros(0, int)
        hi, of = starts[last] + width, owner[fresh]
        docs, at = np.unique(of, return_index=True)
        spans = np.stack([lo - first[of], hi - first[of]], 1).astype("<i8")
        edge = [*at.tolist(), len(of)]
        return pa.table(
            {
                "doc_id": keys["doc_id"].take(pa.array(docs)),
                "text_hash": keys["text_hash"].take(pa.array(docs)),
                "spans": pa.array([spans[edge[i] : edge[i + 1]].tobytes() for i in range(len(docs))], pa.binary()),
            }
        )

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def removal_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_hash, spans): for each document with repeated windows its removal intervals.

    ``spans`` is little-endian int64 pairs of word positions, start and end, ascending and apart.
    """
    worker_imports(docs.sparkSession)
    each = grown(docs, BUCKET_BYTES, MOST_BUCKET_BYTES)
    buckets = parts_for(docs, each, least=int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2)
    sent = _keyed(steady(docs)).mapInArrow(_send(width, buckets, 2 * each), _SENT)
    counted = sent.groupBy("bucket").applyInArrow(_count, "batch string, keys binary, marked binary")
    merged = counted.groupBy("batch").applyInArrow(_merge(width), "doc_id long, text_hash long, spans binary")
    return merged.groupBy("doc_id", "text_hash").agg(F.first("spans").alias("spans"))  # repeated rows have the same spans


def kept_words(words: Words, spans: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Removed words of each text, and the kept words joined by one space as bytes and offsets."""
    change = np.zeros(len(words.start) + 1, np.int32)
    for i, x in enumerate(spans):
        if x:
            pairs = np.frombuffer(x, "<i8").reshape(-1, 2) + words.first[i]
            np.add.at(change, pairs[:, 0], 1)
            np.add.at(change, pairs[:, 1], -1)
    keep = np.cumsum(change[:-1]) == 0
    total = np.concatenate([[0], np.cumsum(keep)])
    kept = total[words.first[1:]] - total[words.first[:-1]]
    buf = words.texts.buf.copy()
    start, end = words.start[keep], words.end[keep]
    followed = np.ones(len(start), bool)
    followed[np.cumsum(kept)[kept > 0] - 1] = False
    buf[end[followed]] = 0x20
    cover = np.zeros(len(buf) + 2, np.int32)
    np.add.at(cover, start, 1)
    np.add.at(cover, end + followed, -1)
    inside = np.cumsum(cover[: len(buf)]) > 0
    off = np.concatenate([[0], np.cumsum(inside)])[words.texts.off]
    return words.count - kept, buf[inside], off


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words = Texts(batch.column("text")).words()
        removed, data, off = kept_words(words, batch.column("spans").to_pylist())
        view = memoryview(np.ascontiguousarray(data))
        sha = [hashlib.sha256(view[off[i] : off[i + 1]]).hexdigest() for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(words.count, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def substring_digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    spans, may, whole = _split(_keyed(docs), F.col("doc_id"), F.col("text_hash"), docs, width)
    joined = may.join(spans, F.col("doc_id").eqNullSafe(F.col("_cut_id")) & (F.col("text_hash") == F.col("_cut_hash")), "left")
    rows = joined.select("doc_id", "text", F.col("_cut_spans").alias("spans")).unionByName(whole.select("doc_id", "text", F.lit(None).cast("binary").alias("spans")))
    return rows.mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _split(rows: DataFrame, doc_id, text_hash, docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored removal intervals (_cut_id, _cut_hash, _cut_spans), the ``rows`` that may have some, and those that have none."""
    spans = store(removal_spans(docs, width).select(F.col("doc_id").alias("_cut_id"), F.col("text_hash").alias("_cut_hash"), F.col("spans").alias("_cut_spans")), "spans")
    return spans, *split(rows, F.xxhash64(doc_id, text_hash), bit_table(F.xxhash64("_cut_id", "_cut_hash"), spans))


def _rewrite(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their removal intervals in the last column; names do not matter."""
        for batch in slices(batches, at):
            spans = batch.column(batch.num_columns - 1).to_pylist()
            _, data, off = kept_words(Texts(batch.column(at)).words(), spans)
            whole = data.tobytes()
            texts = [whole[off[i] : off[i + 1]].decode() if x else t for i, (x, t) in enumerate(zip(spans, batch.column(at).to_pylist(), strict=True))]
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])
        let_go()

    return run


def dedup_substrings(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with repeated windows cut from ``text``; a text that loses words is its kept words joined by one space."""
    spans, may, whole = _split(docs, F.col("doc_id").cast("long"), F.xxhash64("text"), docs, width)
    packed = may.select(F.struct("*").alias("_doc"), F.col("doc_id").cast("long").alias("_own_id"), F.xxhash64("text").alias("_own_hash"))
    joined = packed.join(spans, F.col("_own_id").eqNullSafe(F.col("_cut_id")) & (F.col("_own_hash") == F.col("_cut_hash")), "left").select("_doc.*", "_cut_spans")
    return joined.mapInArrow(_rewrite(docs.columns.index("text")), docs.schema).unionByName(whole)
