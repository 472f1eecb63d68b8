"""Structured Streaming forms: collecting from a folder, rate limits, silence and history by key.

The same rules as the batch operators: a window opens at a key's first hit after the last one's end,
and a gap is measured to strictly earlier coverage. State is one small row a key, held by ``transformWithState``; where
rows carry a watermark a timer ends it, so keys that stay away cost nothing, and a registry of keys has a bound of its
own. A query that is started again on its checkpoint goes on where it stopped. State needs the RocksDB store:
``spark.sql.streaming.stateStore.providerClass`` set to ``ROCKSDB``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from cuelens.lexicon.rules import Pack
from cuelens.operators import decisions, scoring, substance

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000


def read_folder(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """Landed Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def screen(docs: DataFrame, pack: Pack) -> DataFrame:
    """Screening of a stream of documents: every step is row by row, so no state is kept."""
    rows = substance.cut(substance.normalise(docs), pack).withColumn("source_class", scoring.source_class(F.col("text"), pack))
    return decisions.intake(decisions.adoption(rows, pack), pack)


def once(docs: DataFrame, event_time: str, delay: str = "1 day") -> DataFrame:
    """Pastes once within the watermark."""
    key = F.sha2(F.regexp_replace("text", r"\s+", ""), 256)
    return docs.withWatermark(event_time, delay).withColumn("paste_key", key).dropDuplicatesWithinWatermark(["paste_key"])


def _stateful(rows: DataFrame, by: str, processor: StatefulProcessor, kind: StructType | str, timed: bool) -> DataFrame:
    if rows.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    return rows.groupBy(by).transformWithState(processor, kind, "append", "EventTime" if timed else "None")


class _Expiring(StatefulProcessor):
    """One value a key. Where it is timed, the last timer that was set for a key ends its value."""

    state = "value long"

    def __init__(self, timed: bool):
        self.timed = timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.state)

    def keep(self, value: tuple, until_ms: int, timer_values) -> None:
        self.value.update(value)
        if self.timed:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(max(until_ms, timer_values.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Windows(_Expiring):
    state = "opened long, n int"

    def __init__(self, timed: bool, seconds: int, limit: int):
        super().__init__(timed)
        self.length, self.limit = seconds * SECOND, limit

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        opened, n = self.value.get() if self.value.exists() else (None, 0)
        for t in sorted(r.t for r in rows):
            if opened is None or t >= opened + self.length:
                opened, n = t, 0
            n += 1
            yield Row(k=key[0], t=t, opened=opened, n=n, allowed=n <= self.limit)
        self.keep((opened, n), (opened + self.length) // 1000, timerValues)


def _keyed(rows: DataFrame, key: str, ts: str, delay: str | None, *more) -> tuple[DataFrame, str]:
    """(k, at, t, ...): key, time with its watermark, and the time in microseconds; rows without a time are left out."""
    at = F.col(ts).cast("timestamp")
    out = rows.where(F.col(ts).isNotNull()).select(F.col(key).alias("k"), at.alias("at"), F.unix_micros(at).alias("t"), *more)
    return out.withWatermark("at", delay) if delay else out, rows.schema[key].dataType.simpleString()


def limit_hits(hits: DataFrame, key: str, ts: str, seconds: int, limit: int, delay: str | None = None) -> DataFrame:
    """(key, ts, opened, n, allowed) of each hit of a stream.

    With ``delay``, hits may be so late, and a timer ends a key's state once its window is over by then; without, it is kept.
    """
    rows, kind = _keyed(hits, key, ts, delay)
    out = _stateful(rows, "k", _Windows(bool(delay), seconds, limit), f"k {kind}, t long, opened long, n int, allowed boolean", bool(delay))
    return out.select(F.col("k").alias(key), F.timestamp_micros("t").alias(ts), F.timestamp_micros("opened").alias("opened"), "n", "allowed")


class _Registry(StatefulProcessor):
    def __init__(self, seconds: int, limit: int, most: int):
        self.length, self.limit, self.most = seconds * SECOND, limit, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.windows = handle.getMapState("windows", "k string", "opened long, place long, n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = {k[0]: tuple(v) for k, v in self.windows.iterator()} if self.windows.exists() else {}
        # in order of opening: the oldest stand first, so what is over and what is evicted is always a beginning
        held = dict(sorted(before.items(), key=lambda x: x[1][1]))
        place = max((v[1] for v in held.values()), default=0)
        for t, k in sorted((r.t, r.k) for r in rows):
            if k not in held or t >= held[k][0] + self.length:
                while held and (held[oldest := next(iter(held))][0] + self.length <= t or len(held) >= self.most):
                    del held[oldest]
                place += 1
                held[k] = (t, place, 0)
            opened, at, n = held[k]
            held[k] = (opened, at, n + 1)
            yield Row(k=k, t=t, opened=opened, n=n + 1, allowed=n < self.limit)
        for k in before.keys() - held.keys():
            self.windows.removeKey((k,))
        for k, v in held.items():
            if before.get(k) != v:
                self.windows.updateValue((k,), v)

    def close(self) -> None:
        pass


def limit_registry(hits: DataFrame, key: str, ts: str, seconds: int, limit: int, most_keys: int = 5000, shards: int = 1) -> DataFrame:
    """(key, ts, opened, n, allowed) of each hit, with ``most_keys`` windows at most in each of ``shards`` registries.

    Before a window opens, windows that are over go, and then the oldest while there is no room: a key that was
    evicted starts anew at its next hit. Keys are texts and belong to one shard by their hash; a shard's hits are taken in order of
    time, then key, within a batch, so a batch is the unit in which late hits are put in order.
    """
    rows, kind = _keyed(hits.withColumn(key, F.col(key).cast("string")), key, ts, None)
    sharded = rows.where("k is not null").withColumn("shard", F.pmod(F.xxhash64("k"), F.lit(shards)).cast("int"))
    out = _stateful(sharded, "shard", _Registry(seconds, limit, most_keys), f"k {kind}, t long, opened long, n int, allowed boolean", False)
    return out.select(F.col("k").alias(key), F.timestamp_micros("t").alias(ts), F.timestamp_micros("opened").alias("opened"), "n", "allowed")


class _Silence(_Expiring):
    #: Latest time with all rows up to it, and what was before that time: rows of one time are no coverage of each other.
    state = "last long, n long, before long, n_before long"

    def __init__(self, timed: bool, gap_days: int, keep_days: int):
        super().__init__(timed)
        self.gap_days, self.keep_ms = gap_days, keep_days * 86_400_000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, n, before, n_before = self.value.get() if self.value.exists() else (None, 0, None, 0)
        for t, thin in sorted((r.t, r.thin) for r in rows):
            if last is None or t > last:
                before, n_before = last, n
                last = t
            prior, count = (before, n_before) if t == last else (t, n)  # a late row has later coverage already: no gap
            n += 1
            if count:
                days = max(0, (t - prior) // 86_400_000_000)
                yield Row(k=key[0], t=t, prior_count=count, gap_days=days, silent=days > self.gap_days and thin)
        self.keep((last, n, before, n_before), last // 1000 + self.keep_ms, timerValues)


def silences(rows: DataFrame, subject: str, ts: str, gap_days: int = 14, band: str | None = None, delay: str | None = None, keep_days: int = 365) -> DataFrame:
    """(subject, ts, prior_count, gap_days, silent) of each row of a stream that has prior coverage.

    A row is silent if the gap is longer than ``gap_days`` and, where ``band`` names a column, the row is thin. With ``delay`` a subject is
    forgotten ``keep_days`` after its last row by the watermark, and is new when it comes back; without, it is kept.
    """
    thin = (F.coalesce(F.col(band) == "thin", F.lit(False)) if band else F.lit(True)).alias("thin")
    own, kind = _keyed(rows, subject, ts, delay, thin)
    out = _stateful(own, "k", _Silence(bool(delay), gap_days, keep_days), f"k {kind}, t long, prior_count long, gap_days int, silent boolean", bool(delay))
    return out.select(F.col("k").alias(subject), F.timestamp_micros("t").alias(ts), "prior_count", "gap_days", "silent")


def cooled(calls: DataFrame, ts: str, status: str, seconds: int = 60, provider: str | None = None) -> DataFrame:
    """``calls`` with allowed: none within ``seconds`` after a refusal for rate (status 429) that was itself allowed.

    A refused provider is left alone for that long; calls in between are not made, so their status does not count. A pause of
    more than a cooldown between refusals always ends it, so each burst between such pauses is folded apart. Refusals that
    count are further apart than a cooldown, so a call meets at most two of them, in its own stretch of time and the one before.
    Rows without a time are allowed; without ``provider`` all calls are one provider's.
    """
    length = seconds * SECOND
    who, at = (F.col(provider) if provider else F.lit("all")), F.unix_micros(F.col(ts).cast("timestamp"))
    refused = calls.where((F.col(status) == 429) & F.col(ts).isNotNull()).select(who.alias("_who"), at.alias("_t")).distinct()
    own = Window.partitionBy("_who").orderBy("_t")
    fresh = F.coalesce(F.col("_t") - F.lag("_t").over(own) > length, F.lit(True)).cast("int")
    bursts = refused.withColumn("_fresh", fresh).withColumn("_burst", F.sum("_fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    apart = F.aggregate(
        F.array_sort(F.collect_list("_t")), F.array().cast("array<bigint>"),
        lambda done, t: F.when((F.size(done) > 0) & (t <= F.try_element_at(done, F.lit(-1)) + length), done).otherwise(F.concat(done, F.array(t))),
    )
    counted = bursts.groupBy("_who", "_burst").agg(apart.alias("_each")).select("_who", F.explode("_each").alias("_refusal"))
    stretch = F.floor(F.col("_refusal") / length)
    reach = counted.select("_who", "_refusal", F.explode(F.array(stretch, stretch + 1)).alias("_stretch"))
    asked = calls.select(F.struct("*").alias("_call"), who.alias("_by"), at.alias("_at"), F.floor(at / length).alias("_in"))
    hit = F.col("_who").eqNullSafe(F.col("_by")) & (F.col("_stretch") == F.col("_in")) & (F.col("_at") > F.col("_refusal")) & (F.col("_at") <= F.col("_refusal") + length)
    return asked.join(reach, hit, "left").select("_call.*", F.col("_refusal").isNull().alias("allowed"))


class _Prior(StatefulProcessor):
    def __init__(self, subject: str):
        self.subject = subject

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.count.get()[0] if self.count.exists() else 0
        n = 0
        for n, r in enumerate(rows, 1):
            yield Row(**r.asDict(), prior=before)
        self.count.update((before + n,))

    def close(self) -> None:
        pass


def with_history(rows: DataFrame, subject: str) -> DataFrame:
    """``rows`` of a stream with prior: rows of their subject in all batches before, which earlier runs may have taken.

    Counts are state by subject, so a batch reads the counts of its own subjects and not the store. A batch that is run
    again sees the counts of the batches before it.
    """
    return _stateful(rows, subject, _Prior(subject), StructType([*rows.schema.fields, StructField("prior", LongType())]), False)


def run_once(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None):
    """Take what has landed and stop; ``each`` replaces the Parquet sink by a function of micro-batches. Returns the ended query."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", path).start()
    query.awaitTermination()
    return query
