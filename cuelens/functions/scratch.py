"""Tables written once and read by several branches of a plan, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset and all run on this machine a temporary folder, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="cuelens-"))
    return found.rstrip("/")


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, written and read back; deleted when the process ends, since the plans that read it run later."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/cuelens-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception:  # the session is gone; its folder goes with the cluster's own clean-up
            continue
