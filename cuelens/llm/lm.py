"""LM scoring: subword lattice likelihood with probabilities learned from the training documents.

A text is its words, ASCII lower-cased, and one end. A word's probability is that of all its
segmentations into pieces of an existing vocabulary, and of one arc more: a word that the training
documents hold is a piece of its own, with its count less a discount; what the discounts free is the
weight of the segmentations (interpolation; the discount is n1 / (n1 + 2 n2), of words seen once and
twice). So the probabilities of all words sum to 1 at most.

Every batch of documents (a block) sends its
distinct words once, packed by hash bucket, one record for each bucket that gets a word; buckets add up the training counts of all distinct words.
From these counts the pieces' probabilities are re-estimated (expectation maximisation over all
segmentations of all distinct training words), each distinct word is scored once, and the scores go back to
the blocks, where documents add up their tokens. No text is shuffled, a frequent word is one entry a
block, and what reaches the driver is one number a piece.

Defined cases: a null or wordless text is its end alone; a null doc_id counts as held out and is an id
like any other; rows that repeat are documents of their own; with no training documents the counts are
0, the base is as its formula says (V = 0), and the pieces keep their first weights; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelens.llm.lattice import Lattice, load_pieces
from cuelens.llm.rows import bucket_of_id
from cuelens.llm.session import grown, parts_for, store, worker_imports
from cuelens.llm.textkit import Texts, hash_spans, slices

#: Stored input for one bucket, and at most; a block has twice as much raw text.
BUCKET_BYTES, MOST_BUCKET_BYTES = 8 << 20, 32 << 20
EM_ROUNDS = 2
SMOOTHING = 0.01
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True

_SENT = "block string, bucket int, first int, words binary, counts binary, docs binary, tokens binary"


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _open(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _planes(x: np.ndarray) -> bytes:
    """An integer array with its byte planes apart, compressed."""
    return _squeeze(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes())


def _unplanes(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(_open(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _hashed(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts, ends and hashes of words that line feeds end."""
    buf = np.frombuffer(packed, np.uint8)
    end = np.flatnonzero(buf == 0x0A)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    return buf, start, end, hash_spans(buf, start, end, 4)


def _home(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash, rising with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _send(buckets: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, batch in enumerate(slices(batches, "text", block_bytes)):
            texts = Texts(batch.column("text"))
            texts.buf = _LOWER[texts.buf]
            words = texts.words(_GAP)
            hashes = words.hashes(4)
            names, sample, token = np.unique(hashes, return_index=True, return_inverse=True)
            trains = ~np.asarray(batch.column("held_out").to_numpy(zero_copy_only=False), bool)
            counts = np.bincount(token, trains[words.owner()], len(names)).astype("<u4")
            start, end = words.start[sample].tolist(), words.end[sample].tolist()
            raw = texts.buf.tobytes()
            home = _home(names, buckets)
            edge = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1], [True]])).tolist() if len(home) else [0]
            rows: dict[str, list] = {c: [] for c in ("bucket", "first", "words", "counts", "docs", "tokens")}
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                packed = b"".join([raw[s:e] + b"\n" for s, e in zip(start[lo:hi], end[lo:hi], strict=True)])
                for c, v in zip(rows, (int(home[lo]), lo, _squeeze(packed), _planes(counts[lo:hi]), None, None), strict=True):
                    rows[c].append(v)
            docs = pa.table({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n": pa.array(words.count)})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(docs)
            for c, v in zip(rows, (-1, len(names), None, None, sink.getvalue().to_pybytes(), _planes(token.astype("<u4"))), strict=True):
                rows[c].append(v)
            kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([f"{part}-{k}"] * len(rows["bucket"])), *(pa.array(rows[c], t) for c, t in zip(rows, kinds, strict=True))], ["block", *rows])

    return run


def _distinct(table: pa.Table) -> pa.Table:
    """Of one bucket: its distinct words in order of hash and their training counts."""
    packed = b"".join(_open(x.as_py()) for x in table["words"])
    buf, start, end, hashes = _hashed(packed)
    names, sample, of = np.unique(hashes, return_index=True, return_inverse=True)
    counts = np.bincount(of, np.concatenate([_unplanes(x.as_py(), "<u4") for x in table["counts"]]), len(names)).astype("<i8")
    words = b"".join([packed[s : e + 1] for s, e in zip(start[sample].tolist(), end[sample].tolist(), strict=True)])
    return pa.table(
        {
            "bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "words": pa.array([_squeeze(words)], pa.binary()), "counts": pa.array([_planes(counts)], pa.binary()),
            "n": pa.array([int(counts.sum())], pa.int64()), "v": pa.array([int((counts > 0).sum())], pa.int64()),
            "n1": pa.array([int((counts == 1).sum())], pa.int64()), "n2": pa.array([int((counts == 2).sum())], pa.int64()),
        }
    )


def _expect(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, log_p = model.value
        lattice = Lattice(load_pieces(path), log_p)
        total = np.zeros(len(log_p))
        for batch in batches:
            for words, counts in zip(batch.column("words"), batch.column("counts"), strict=True):
                c = _unplanes(counts.as_py(), "<i8")
                seen = np.flatnonzero(c)
                names = _open(words.as_py()).split(b"\n")
                total += lattice.expected([names[i] for i in seen], np.ones(len(seen)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["piece", "n"])

    return run


def fit_pieces(words: DataFrame, path: str, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Natural log-probabilities of the pieces, from a table of distinct words and counts; a word seen counts once.

    They back off for words that are rare or unseen, and those look like the distinct words, not like
    the frequent ones.
    """
    weight = load_pieces(path).weight
    log_p = np.log(weight / weight.sum())
    for _ in range(rounds):
        model = words.sparkSession.sparkContext.broadcast((path, log_p))
        found = words.select("words", "counts").mapInArrow(_expect(model), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        n = np.zeros(len(weight))
        n[found["piece"].to_numpy()] = found["n"].to_numpy()
        if not n.any():
            break
        log_p = np.log((n + SMOOTHING) / (n.sum() + SMOOTHING * len(n)))
    return log_p


def _return(model):
    """Of one bucket: each block gets the counts and scores of the words it sent, in the order it sent them."""

    def run(key: tuple, sent: pa.Table, known: pa.Table) -> pa.Table:
        path, log_p, totals = model.value
        words = _open(known["words"][0].as_py())
        counts = _unplanes(known["counts"][0].as_py(), "<i8")
        names = _hashed(words)[3]
        log_lattice = Lattice(load_pieces(path), log_p).log_words(words.split(b"\n")[:-1])
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(counts - totals["discount"], 0) / max(1, totals["n"]))
        score = np.logaddexp(whole, totals["log_free"] + log_lattice) / np.log(10)
        out_c, out_s = [], []
        for x in sent["words"]:
            at = np.searchsorted(names, _hashed(_open(x.as_py()))[3])
            out_c.append(_planes(counts[at]))
            out_s.append(_planes(score[at].astype("<f8")))
        return pa.table({"block": sent["block"], "first": sent["first"], "counts": pa.array(out_c, pa.binary()), "scores": pa.array(out_s, pa.binary())})

    return run


def _sum(totals: dict):
    n_train, v, ends = (totals[k] for k in ("n", "v", "ends"))
    end_score = float(np.log10(ends / n_train)) if ends else float(np.log10(0.01))

    def run(key: tuple, blocks: pa.Table, back: pa.Table) -> pa.Table:
        with np.errstate(divide="ignore"):
            base_of = lambda c: np.log10((c + 0.1) / (n_train + 0.1 * (v + 1)))
        columns: dict[str, list] = {c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")}
        for docs_data, token_data, size in zip(blocks["docs"], blocks["tokens"], blocks["first"], strict=True):
            docs, token = pa.ipc.open_stream(docs_data.as_py()).read_all(), _unplanes(token_data.as_py(), "<u4")
            counts, score = np.zeros(size.as_py(), np.int64), np.zeros(size.as_py())
            for first, c, s in zip(back["first"].to_pylist(), back["counts"], back["scores"], strict=True):
                got = _unplanes(c.as_py(), "<i8")
                counts[first : first + len(got)], score[first : first + len(got)] = got, _unplanes(s.as_py(), "<f8")
            n = docs["n"].to_numpy()
            of = np.repeat(np.arange(len(n)), n)
            values = (
                docs["doc_id"], docs["held_out"], n + 1, np.bincount(of, counts[token] > 0, len(n)).astype(np.int64) + int(ends > 0), np.full(len(n), n_train),
                np.bincount(of, base_of(counts)[token], len(n)) + base_of(ends), np.bincount(of, score[token], len(n)) + end_score,
            )
            for name, x in zip(columns, values, strict=True):
                columns[name].append(x.combine_chunks() if isinstance(x, pa.ChunkedArray) else pa.array(x))
        return pa.table({k: pa.chunked_array(x) for k, x in columns.items()})

    return run


def lm_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    worker_imports(spark)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", (bucket_of_id(F.col("doc_id"), 10) == 0).alias("held_out"))
    each = grown(docs, BUCKET_BYTES, MOST_BUCKET_BYTES)
    buckets = parts_for(docs, each, least=2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = store(rows.mapInArrow(_send(buckets, 2 * each), _SENT), "lm-sent")
    ups = sent.where("bucket >= 0").select("block", "bucket", "first", "words", "counts")
    words = store(ups.groupBy("bucket").applyInArrow(_distinct, "bucket int, words binary, counts binary, n long, v long, n1 long, n2 long"), "lm-words")
    found = [x or 0 for x in words.agg(*map(F.sum, ("n", "v", "n1", "n2"))).first()]
    ends = rows.where("not held_out").count()
    totals = {"n": found[0] + ends, "v": found[1] + int(ends > 0), "ends": ends}
    totals["discount"] = min(0.95, max(0.05, found[2] / max(1, found[2] + 2 * found[3])))
    totals["log_free"] = float(np.log(totals["discount"] * found[1] / totals["n"])) if found[1] else float(np.log(0.99))
    model = spark.sparkContext.broadcast((path, fit_pieces(words, path), totals))
    back = ups.groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(_return(model), "block string, first int, counts binary, scores binary")
    blocks = sent.where("bucket < 0").select("block", "first", "docs", "tokens")
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_sum(totals), schema)
