"""What the operators need from the session: worker imports, shared scratch tables, input size."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])
_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def worker_imports(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package; a cluster gets it by ``--py-files``."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *parts])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; one of our own where that is unset and all run on this machine.

    On a cluster without the setting it raises: a folder of one machine would lose or split what executors write.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="cuelens-"))
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/cuelens-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.scratch = path
    return stored


def drop(*stored: DataFrame) -> None:
    """Delete tables of ``store`` that nothing will read again."""
    for df in stored:
        path = df.__dict__.get("scratch")
        if path:
            drop_scratch(df.sparkSession, path)
            _written[:] = [(s, p) for s, p in _written if p != path]


#: Plan nodes that give the same rows in the same order each time a task is run.
_STEADY = {"Project", "Filter", "LogicalRelation", "LocalRelation", "Relation", "Range", "SubqueryAlias", "Union"}


def _nodes(plan) -> list:
    children = plan.children()
    found = [plan]
    for i in range(children.size()):
        found += _nodes(children.apply(i))
    return found


def steady(df: DataFrame) -> DataFrame:
    """``df``, written and read again unless it reads files or local rows alone; an RDD's rows may come from a shuffle.

    Behind a shuffle a task that is run again can meet its rows in another order; operators that name rows by their place need one order.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if plan.deterministic() and all(n.nodeName().split(" ")[0] in _STEADY for n in _nodes(plan)):
        return df
    return store(df, "steady")


def drop_scratch(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                drop_scratch(spark, path)
        except Exception:  # the session is gone; its folder goes with the cluster's own clean-up
            continue


#: Beyond this an estimate is Spark's word for not knowing.
_UNKNOWN = 1 << 52


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``, file sizes for a scan, no job; counted where Spark has none."""
    guess = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if guess < _UNKNOWN:
        return guess
    texts = [F.octet_length(F.col(f"`{f.name}`")) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    row = df.select(sum((F.coalesce(x, F.lit(0)) for x in texts), F.lit(16)).cast("long").alias("n")).agg(F.sum("n")).first()
    return int(row[0] or 0)


def parts_for(df: DataFrame, bytes_each: int, least: int = 1) -> int:
    """How many groups of about ``bytes_each`` of stored input; grows with the input, without a bound."""
    return int(max(least, -(-input_bytes(df) // bytes_each)))


def grown(df: DataFrame, least: int, most: int, at_least_at: int = 4096) -> int:
    """A group's bytes: ``least`` up to ``at_least_at`` groups, then larger ones up to ``most``, so that what passes between groups stays large."""
    return int(min(most, max(least, input_bytes(df) // at_least_at)))
