"""Sending records to a receiver: tried again where it fails, and never sent anew once the receiver took them.

A row's key is the hash of its id and payload. Each batch leaves out keys that the ledger holds as taken, sends the others from the
tasks that hold them, and writes to the ledger what became of each. A run that dies between a receiver's answer and the
ledger sends that row again under the same key, by which a receiver tells it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "key string, id string, taken boolean, tries int, error string"


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(key, id, taken, tries, error, batch) of all batches; none before the first. A ledger that is there but can't be read is an error."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"{LEDGER}, batch long")
    return spark.read.schema(f"{LEDGER}, batch long").parquet(path)


def deliver(send: Callable[[str, str], None], ledger: str, tries: int = 3, pause: float = 0.5) -> Callable[[DataFrame, int], None]:
    """A function of micro-batches (id, payload) for ``run_once``: ``send(key, payload)`` raises where the receiver does not take it.

    Rows that repeat are sent once. What was not taken after ``tries`` goes to the ledger with its error, and is sent again when a later
    batch holds it. A batch that is run again replaces its own part of the ledger and keeps what that part says was taken.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                error, n = None, 0
                for n in range(1, tries + 1):
                    try:
                        send(r["key"], r["payload"])
                        error = None
                        break
                    except Exception as failed:  # whatever a receiver raises is its answer
                        error = f"{type(failed).__name__}: {failed}"[:200]
                        if n < tries:
                            time.sleep(pause * n)
                rows.append({"key": r["key"], "id": r["id"], "taken": error is None, "tries": n, "error": error})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.string()), ("id", pa.string()), ("taken", pa.bool_()), ("tries", pa.int32()), ("error", pa.string())]))

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(F.col("id").cast("string").alias("id"), "payload").where(F.col("payload").isNotNull())
        keyed = rows.select(F.sha2(F.concat_ws("\u0000", F.coalesce("id", F.lit("")), "payload"), 256).alias("key"), "id", "payload").dropDuplicates(["key"])
        past = read_ledger(spark, ledger).where("taken").cache()
        own = past.where(F.col("batch") == number).select(*[f.split()[0] for f in LEDGER.split(", ")])
        kept = spark.createDataFrame(own.collect(), LEDGER)  # the part of this batch that a run before it wrote, one batch's keys at most
        pending = keyed.join(past.select("key").distinct(), "key", "left_anti")
        pending.mapInArrow(post, LEDGER).unionByName(kept).write.mode("overwrite").parquet(f"{ledger}/batch={number}")
        past.unpersist()

    return each
