"""The record store: partitioned Parquet or JSON, listing, restoring, audit log, context cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelens.lexicon.rules import CARD_TYPES


def record_id(date: Column, subscription: Column, source: Column, text: Column) -> Column:
    """``date_subscription_source_hash`` in safe characters: the same record has the same id."""
    slug = lambda c: F.substring(F.regexp_replace(F.lower(c), "[^a-z0-9._-]+", "-"), 1, 80)
    return F.concat_ws("_", F.date_format(date, "yyyyMMdd"), slug(subscription), slug(source), F.left(F.sha2(text, 256), F.lit(8)))


def provenance(rows: DataFrame) -> DataFrame:
    """``rows`` with provenance filled: live for those with an address, else fixture_demo."""
    live = F.col("url").rlike("(?i)^https?://")
    return rows.withColumn("provenance", F.coalesce("provenance", F.when(live, "live").otherwise("fixture_demo")))


def write_records(rows: DataFrame, path: str) -> None:
    """Append records by day and subscription, so that listings prune."""
    rows.withColumn("dt", F.to_date("created_at")).write.mode("append").partitionBy("dt", "subscription_id").parquet(path)


def write_briefs(rows: DataFrame, path: str, live: bool = False) -> None:
    """Append records (with markdown) as JSON and their Markdown as text files' rows, by subscription; ``live`` forces that provenance, as for a saved paste."""
    rows = rows.withColumn("provenance", F.lit("live")) if live else provenance(rows)
    rows.drop("markdown").write.mode("append").partitionBy("subscription_id").json(f"{path}/json")
    rows.select("subscription_id", F.col("markdown").alias("value")).write.mode("append").partitionBy("subscription_id").option("lineSep", "\n\u0000\n").text(f"{path}/markdown")


def list_records(spark: SparkSession, path: str, subscription: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return provenance(rows if subscription is None else rows.where(F.col("subscription_id") == subscription))


def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records, one a file or line; corrupt ones are left out, and a missing provenance is filled where there is an address."""
    rows = spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path).where("_corrupt is null").drop("_corrupt")
    return provenance(rows) if {"provenance", "url"} <= set(rows.columns) else rows


def restore(archive: DataFrame, present: DataFrame) -> DataFrame:
    """Archived records whose id is not present: nothing is overwritten."""
    return archive.join(present.select("id"), "id", "left_anti")


def append_audit(rows: DataFrame, path: str) -> None:
    """One JSON line a decision: text hash and no text."""
    rows.withColumn("source_hash", F.left(F.sha2("text", 256), F.lit(16))).drop("text").write.mode("append").json(path)


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """Context cards of Markdown files: name, type, desks, match, body; an unknown type is a lexicon."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    head = F.regexp_extract("v", r"(?s)^---\n(.*?)\n---", 1)
    field = lambda k: F.trim(F.regexp_extract(head, rf"(?m)^{k}:[ ]*(.*)$", 1))
    desks = F.transform(F.regexp_extract_all(field("desk"), F.lit(r"[A-Za-z_]+"), F.lit(0)), lambda d: F.when(d == "overall_goals", "economy_investment").otherwise(d))
    kind = field("type")
    return raw.select(
        field("name").alias("name"),
        F.when(kind.isin(*CARD_TYPES), kind).otherwise("lexicon").alias("type"),
        desks.alias("desks"),
        F.regexp_extract_all(field("match"), F.lit('"([^"]+)"'), F.lit(1)).alias("match"),
        F.regexp_replace(F.regexp_replace("v", r"(?s)^---\n.*?\n---\n?", ""), r"^\s+|\s+$", "").alias("body"),
    )


def one_archive(rows: DataFrame, path: str) -> None:
    """Live records as JSON, anew each time; as many files as the records fill."""
    rows.where(F.col("provenance") == "live").write.mode("overwrite").option("maxRecordsPerFile", 100_000).json(path)
