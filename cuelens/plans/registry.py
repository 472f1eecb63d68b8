"""Queries register here with the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Bytes of a table's columns, by Spark's estimate, for each task that rules are matched in.
TASK_BYTES = 2 << 20


#: Rows for each task of a table of narrow rows, whose columns are far smaller in files than what is made of them.
TASK_ROWS = 50_000


def spread(rows: DataFrame, narrow: bool = False) -> DataFrame:
    """``rows`` dealt by their first column, a unique key, over all cores at least and a task for each ``TASK_BYTES``; ``narrow`` rows are counted too, a task for each ``TASK_ROWS``.

    Files are split by row groups alone, and a file may have one; rules cost far more than the shuffle of the texts.
    """
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = [rows.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)]
    if narrow:
        tasks.append(-(-rows.count() // TASK_ROWS))  # of a file, a count reads the footers alone
    return rows.repartition(max(tasks), rows.columns[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
