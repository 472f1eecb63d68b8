"""The record store over time: silence, rate windows, listings, feeds, audit, boards, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelens.functions.markup import xml_escape


def _micros(ts: str) -> Column:
    """Microseconds of a timestamp of either kind."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def silence(rows: DataFrame, subject: list[str], ts: str, gap_days: int = 14, band: str | None = None) -> DataFrame:
    """``rows`` with prior_count, last_prior and gap_days against the subject's rows of an earlier time, and silent.

    Rows of the same time are no coverage of each other. A row is silent if the gap is longer than ``gap_days`` and, where
    ``band`` names a column, the row is thin.
    """
    before = Window.partitionBy(*subject).orderBy(_micros(ts)).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"prior_count": F.count("*").over(before), "last_prior": F.max(ts).over(before)})
    gap = F.floor((_micros(ts) - _micros("last_prior")) / 86_400_000_000).cast("int")
    rows = rows.withColumn("gap_days", F.when(F.col("last_prior").isNotNull(), F.greatest(F.lit(0), gap)))
    quiet = F.coalesce(F.col("gap_days") > gap_days, F.lit(False))
    return rows.withColumn("silent", quiet & F.coalesce(F.col(band) == "thin", F.lit(False)) if band else quiet)


def rate_windows(rows: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """(key, opened, n, n_refused): windows that open at a key's first hit after the last one's end.

    A gap as long as a window always ends it, so each burst between such gaps is folded apart.
    """
    micros = rows.select(key, _micros(ts).alias("t"))
    w = Window.partitionBy(key).orderBy("t")
    fresh = F.coalesce(F.col("t") - F.lag("t").over(w) >= seconds * 1_000_000, F.lit(True)).cast("int")
    bursts = micros.withColumn("fresh", fresh).withColumn("burst", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    empty = F.array().cast("array<struct<opened:bigint,n:int>>")

    def step(done: Column, t: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        inside = (F.size(done) > 0) & (t < last["opened"] + seconds * 1_000_000)
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["opened"].alias("opened"), (last["n"] + 1).alias("n"))))
        return F.when(inside, grown).otherwise(F.concat(done, F.array(F.struct(t.alias("opened"), F.lit(1).alias("n")))))

    folded = bursts.groupBy(key, "burst").agg(F.aggregate(F.array_sort(F.collect_list("t")), empty, step).alias("ws"))
    out = folded.select(key, F.explode("ws").alias("w"))
    return out.select(key, F.timestamp_micros("w.opened").cast("timestamp_ntz").alias("opened"), F.col("w.n").alias("n"), F.greatest(F.lit(0), F.col("w.n") - limit).alias("n_refused"))


def feed(rows: DataFrame, title: Column, body: Column, order: list[Column], most: int = 50) -> DataFrame:
    """(k, item): the first ``most`` rows in order as RSS items; the limit is the feed's."""
    item = F.concat(F.lit("<item><title>"), xml_escape(title), F.lit("</title><description>"), xml_escape(body), F.lit("</description></item>"))
    top = rows.withColumn("item", item).orderBy(*order).limit(most)
    return top.withColumn("k", F.row_number().over(Window.orderBy(*order))).select("k", "item")


def source_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256."""
    return F.left(F.sha2(text, 256), F.lit(16))


def board(rows: DataFrame, section: str) -> DataFrame:
    """By section: items, highest and mean score, roles, whether direction and instrument both occur, and where rows have ``missing``, all that any of them lacks."""
    roles = F.array_sort(F.collect_set("role"))
    gaps = [F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("missing")))), ",").alias("gaps")] if "missing" in rows.columns else []
    return rows.groupBy(section).agg(
        F.count("*").alias("n_items"),
        F.max("score").alias("max_score"),
        F.round(F.avg("score"), 2).alias("avg_score"),
        F.array_join(roles, ",").alias("roles"),
        (F.bool_or("direction") & F.bool_or("instrument")).alias("pairable"),
        *gaps,
    )


def merge_texts(rows: DataFrame, run: str, order: str, label: Column, text: str) -> DataFrame:
    """One text a run: ``[label]`` and text of each item in order; a run's items are one record's."""
    piece = F.concat(F.lit("["), label, F.lit("]\n"), F.coalesce(text, F.lit("")))
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("p"))))
    return rows.groupBy(run).agg(F.count("*").alias("n_items"), F.array_join(F.transform(items, lambda x: x["p"]), "\n\n").alias("merged"))
