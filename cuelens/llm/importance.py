"""Target-distribution importance resampling over hashed word n-grams.

A feature is a run of 1 to n words of a text, joined by one space; its bucket is the CRC-32 of its bytes modulo the
number of buckets. One scan of a text keeps the running zlib states of the last n starts: each state is extended by
a space and the next word, which gives the CRC of the run that is one word longer, so no feature is ever put
together. The scan works on stretches of words and hands the open states on to the next stretch.

Counts of the buckets are summed in each task before they are shuffled; the gains of all buckets, a fixed number, are
what the second scan is given. Documents are drawn by weight and Gumbel noise. Their order is a range sort over tasks,
by score, id and place, so that neither one score nor one id has to fit a task; a rank is a row's place in its task
and the rows of the tasks before.

Defined cases: a null text has no words and no features, and weight 0; a null id is the empty string in the noise and
comes last among equal scores; rows that repeat are documents of their own, ranked one after the other; texts of any
length are scanned whole; an empty table gives none; an empty target has no counts; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelens.llm.session import parts_for, store, worker_imports
from cuelens.llm.textkit import slices

BUCKETS, WORDS = 10_000, 2
#: Words of a stretch: the states that a scan keeps.
STRETCH = 1 << 14
#: Rows of one task of the final order, in bytes of what is stored of them.
SORTED_BYTES = 16 << 20
#: Bytes to word bytes: A-Z in lower case, other ASCII but letters and digits as space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def ring(words: list[bytes], n: int, stretch: int = STRETCH) -> Iterator[list[int]]:
    """CRCs of all runs of 1 to ``n`` words, by stretch and length.

    ``open_[k]`` holds the state of the run of k+1 words that ends at the last word of the stretch before.
    """
    open_: list[int] = []
    for lo in range(0, len(words), stretch):
        own = words[lo : lo + stretch]
        spaced = [b" " + w for w in own] if n > 1 else []
        states = list(map(crc32, own))
        yield states
        last = [states[-1]]
        for k in range(1, n):
            # the state of k words that ended one word earlier goes on by this word
            before = [*open_[k - 1 : k], *states[:-1]]
            states = list(map(crc32, spaced[len(own) - len(before) :], before))
            if not states:
                break
            yield states
            last.append(states[-1])
        open_ = last


def features(text: str | None, n: int = WORDS, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of each feature."""
    words = words_of(text)
    crcs = [np.fromiter(x, np.int64, len(x)) for x in ring(words, n)]
    return len(words), np.concatenate(crcs) % buckets if crcs else np.zeros(0, np.int64)


def bucket_counts(texts: DataFrame, n: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all rows of ``texts`` fall in each bucket."""
    worker_imports(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, 0):
            for text in batch.column(0).to_pylist():
                total += np.bincount(features(text, n, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, n: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """What each bucket says for the target: floor(1000 ln) of the ratio of its smoothed shares; ``buckets`` numbers."""
    s, t = (np.zeros(buckets, np.int64) for _ in range(2))
    for counts, table in ((s, raw), (t, target)):
        for bucket, number in bucket_counts(table, n, buckets).collect():
            counts[bucket] = number
    ahead, behind = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * ahead / ((a + 1.0) * behind))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, n: int = WORDS) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains of each document's features."""
    worker_imports(docs.sparkSession)
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                words, found = features(text, n, buckets)
                rows.append((words, len(found), int(gains[found].sum()) // len(found) if len(found) else 0))
            more = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *more], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: str = "7", n: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; rank is null where it is not drawn.

    Of the documents of at least ``least_words`` words, the floor of ``percent`` in a hundred with the highest scores is
    drawn: weight and Gumbel noise from the id's hash, which is drawing without replacement by exp(weight / 1000).
    """
    weighed = weigh(docs, bucket_gains(docs, target, n, buckets), n)
    half = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("double") + 0.5
    noise = F.floor(-1000 * F.log(-F.log(half / 4294967296.0)))
    scored = store(weighed.withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    enough = F.col("n_words") >= least_words
    drawn = percent * scored.where(enough).count() // 100
    keys = [F.desc("score"), F.asc_nulls_last("doc_id")]
    order = scored.where(enough).withColumn("place", F.monotonically_increasing_id())
    order = order.repartitionByRange(parts_for(scored, SORTED_BYTES), *keys, F.col("place")).sortWithinPartitions(*keys, "place").drop("place")
    order = store(order.withColumn("place", F.monotonically_increasing_id()), "order")  # task number above, place in the task in the low 33 bits
    part = F.shiftright("place", 33)
    totals = sorted(map(tuple, order.groupBy(part.alias("part")).agg(F.count("*")).collect()))  # one row a task
    base = np.cumsum([0, *(m for _, m in totals)]).tolist()
    bases = docs.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(totals, base, strict=False)], "part long, base long")
    rank = F.col("base") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    own = ["doc_id", "n_words", "n_features", "weight", "score"]
    ranked = order.join(F.broadcast(bases), part == F.col("part")).select(*own, F.when(rank <= drawn, rank).alias("rank"))
    return ranked.unionByName(scored.where(~enough).select(*own, F.lit(None).cast("long").alias("rank")))


def importance_digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document."""
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
