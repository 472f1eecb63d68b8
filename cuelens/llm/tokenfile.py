"""Token-ID output: Parquet files of list columns, in order of document, for selective reads.

Files: ascending doc_id, one row a document: part int, doc_id, start_in_part long, n_tokens long,
token_ids list<int>. Token ids are dictionary-encoded, doc_id and the counters delta-encoded; row
groups and pages are small and every page is in the page index, so a read of some ids or of the
counters alone skips the rest. A document's start in the whole is its start in its part and the
tokens of the parts before; those totals are one row a part.

Texts are encoded by the tokenizers library word by word: white space never joins two words in this
tokenizer (its pattern drops it), so a process encodes a word once and looks it up by hash from then on.

Defined cases: a null text is an empty one and holds the end id alone; null doc_ids come first; equal
doc_ids are ordered by text, and each row is a document; an empty table gives one empty file; columns
other than doc_id and text are not written.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelens.llm.session import parts_for, scratch_path, steady, worker_imports
from cuelens.llm.textkit import Texts, slices
from cuelens.llm.wordtable import WordTable, split_plain

END_ID = 1
#: Stored input for one file.
FILE_BYTES = 12 << 20
OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start_in_part": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
_SCHEMA = "part int, doc_id long, start_in_part long, n_tokens long, token_ids array<int>"


class Encoder:
    """The library behind tables of words.

    A text of Latin-1 characters is its own NFC form and lower-cased without context, so its words are those the
    tokenizer's pattern finds in the lower-cased bytes; other texts, and those with a special token's marks, are cut
    at ASCII white space alone. Many words are encoded in one call; the ids of each end with a token that has the
    end-of-word mark.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words, self.chunks = WordTable(self._words), WordTable(self._chunks)

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        counts, ids = [], []
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            got = np.array(self.library.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
            stop = np.flatnonzero(self.ends[got]) + 1
            if len(stop) != len(part):
                raise ValueError("the tokenizer joins or splits words in another way than its pattern says")
            counts.append(np.diff(stop, prepend=0)), ids.append(got)
        return np.concatenate(counts), np.concatenate(ids)

    def _chunks(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for k in range(0, len(words), 4096) for x in self.library.encode_batch_fast([w.decode() for w in words[k : k + 4096]], add_special_tokens=False)]
        return np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts' ids, and all ids, without the end id."""
        own = Texts(texts)
        marks = own.buf == ord("<")
        marks[:-1] &= own.buf[1:] == ord("|")
        latin = (own.per_text(own.buf >= 0xC4) == 0) & (own.per_text(marks) == 0)
        size, parts = np.zeros(own.n, np.int64), []
        for some, plain in ((np.flatnonzero(latin), True), (np.flatnonzero(~latin), False)):
            if len(some):
                part = own if len(some) == own.n else Texts(texts.take(pa.array(some)))
                if plain:
                    part.buf = _lower(part.buf)
                    start, end, first = split_plain(part)
                else:
                    words = part.words()
                    start, end, first = words.start, words.end, words.first
                count, ids = (self.words if plain else self.chunks).encode(part.buf, start, end)
                size[some] = np.diff(np.concatenate([[0], np.cumsum(count)])[first])
                parts.append((some, ids))
        off = np.concatenate([[0], np.cumsum(size)])
        if len(parts) == 1:
            return off, parts[0][1]
        out = np.empty(off[-1], np.uint32)
        for some, ids in parts:
            own_size = size[some]
            out[np.repeat(off[some] - (np.cumsum(own_size) - own_size), own_size) + np.arange(len(ids))] = ids
        return off, out


def _lower(buf: np.ndarray) -> np.ndarray:
    """Latin-1 letters in UTF-8 in lower case: A to Z, and the upper ones behind byte C3, but for the multiplication sign."""
    out = buf.copy()
    out[(buf >= 0x41) & (buf <= 0x5A)] += 32
    at = np.flatnonzero(buf[:-1] == 0xC3) + 1
    at = at[(buf[at] <= 0x9E) & (buf[at] != 0x97)]
    out[at] += 32
    return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Write ``docs``' tokens under ``path``, each document ended by END_ID."""
    worker_imports(docs.sparkSession)
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    parts = parts_for(docs, FILE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done, own = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in slices(batches, "text", 2 << 20):
            found, flat = own.encode(batch.column("text"))
            n = batch.num_rows
            off = found + np.arange(n + 1)
            data = np.full(off[-1], END_ID, np.int32)
            inner = np.ones(len(data), bool)
            inner[off[1:] - 1] = False
            data[inner] = flat
            ids = pa.array(data)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * n, pa.int32()), batch.column("doc_id"), pa.array(done + off[:-1], pa.int64()), pa.array(np.diff(off), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(off, pa.int32()), ids),
                ],
                ["part", "doc_id", "start_in_part", "n_tokens", "token_ids"],
            )
            done += int(off[-1])

    rows = steady(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("place"))
    # an id that holds a large share of all rows is dealt over several files by its texts' beginnings and its rows' places
    rows = rows.repartitionByRange(parts, "doc_id", F.left("text", F.lit(32)), "place").sortWithinPartitions("doc_id", "text").drop("place")
    rows.mapInArrow(run, _SCHEMA).write.options(**OPTIONS).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows: part, doc_id, start_in_part, n_tokens, token_ids. Filters on doc_id reach the page index."""
    return spark.read.schema(_SCHEMA).parquet(path)


def token_starts(files: DataFrame) -> DataFrame:
    """(part, base): tokens of all parts before each; one row a file, summed on the driver."""
    totals = sorted(map(tuple, files.groupBy("part").agg(F.sum("n_tokens")).collect()))
    base = np.cumsum([0, *(n for _, n in totals)]).tolist()
    return files.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(totals, base, strict=False)], "base_part int, base long")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "token_ids"):
        lists = batch.column("token_ids")
        off = lists.offsets.to_numpy().astype(np.int64)
        ids, off = lists.values.slice(off[0], off[-1] - off[0]).to_numpy(zero_copy_only=False).astype("<u4"), off - off[0]
        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write, read back: doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    files = read_tokens(spark, path)
    based = files.join(F.broadcast(token_starts(files)), F.col("part") == F.col("base_part"))
    rows = based.select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "token_ids")
    return rows.mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
