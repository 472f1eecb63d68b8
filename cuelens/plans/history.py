"""Queries over time and over the record store. Orders play records, customers their subscriptions, events coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelens.operators import decisions, history
from cuelens.plans.registry import query, table

NOW = "2001-09-01"
_AGED = f"""aged AS (SELECT o_orderkey, o_orderdate, o_orderpriority, CASE left(o_orderpriority, 1) WHEN '5' THEN 'relative' WHEN '4' THEN 'none' ELSE 'day' END AS prec,
  CASE WHEN left(o_orderpriority, 1) <> '4' THEN date_diff('day', CAST(o_orderdate AS DATE), DATE '{NOW}') END AS age FROM orders),
  fresh AS (SELECT *, CASE WHEN age IS NULL OR prec = 'none' THEN 'unknown' WHEN prec = 'relative' THEN 'weak' WHEN age <= 7 THEN 'fresh' WHEN age <= 30 THEN 'recent' WHEN age <= 90 THEN 'aging' ELSE 'stale' END AS band FROM aged)"""


def aged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with age in days, precision and freshness; the clock is ``NOW``."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    kind = F.substring("o_orderpriority", 1, 1)
    rows = rows.withColumn("prec", F.when(kind == "5", "relative").when(kind == "4", "none").otherwise("day"))
    rows = rows.withColumn("age", F.when(kind != "4", F.datediff(F.lit(NOW).cast("date"), F.col("o_orderdate").cast("date"))))
    return rows.withColumn("band", decisions.freshness(F.col("age"), F.col("prec")))


@query(f"WITH {_AGED} SELECT o_orderkey, CAST(age AS INT) AS age_days, band FROM fresh")
def q22_as_of_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age and freshness band of each record."""
    return aged(spark, sf_dir).select("o_orderkey", F.col("age").alias("age_days"), "band")


@query(
    f"""WITH {_AGED}, l AS (SELECT *, CASE left(o_orderpriority, 1) WHEN '1' THEN 2 WHEN '2' THEN 1 WHEN '3' THEN 1 ELSE 0 END AS lk, CASE WHEN band = 'unknown' THEN 0 WHEN band IN ('stale', 'aging', 'weak') THEN 1 ELSE 2 END AS cap FROM fresh)
    SELECT band, ['low', 'medium', 'high'][lk + 1] AS likelihood, ['low', 'medium', 'high'][least(lk, cap) + 1] AS clamped, count(*) AS n FROM l GROUP BY ALL"""
)
def q23_quality_and_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood by priority, clamped by freshness."""
    rows = aged(spark, sf_dir)
    kind = F.substring("o_orderpriority", 1, 1)
    likelihood = F.when(kind == "1", "high").when(kind.isin("2", "3"), "medium").otherwise("low")
    rows = rows.select("band", likelihood.alias("likelihood"))
    return rows.withColumn("clamped", decisions.clamp_likelihood(F.col("likelihood"), F.col("band"))).groupBy("band", "likelihood", "clamped").agg(F.count("*").alias("n"))


@query(
    """WITH g AS (SELECT a.event_id, a.ts, a.value, count(*) AS prior_count, max(b.ts) AS last_prior FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.ts < a.ts GROUP BY ALL)
    SELECT event_id, prior_count, CAST(floor((epoch_us(ts) - epoch_us(last_prior)) / 86400000000) AS INT) AS gap_days, floor((epoch_us(ts) - epoch_us(last_prior)) / 86400000000) > 14 AND value < 50 AS silent FROM g"""
)
def q24_silence_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap to strictly earlier coverage of a subject; silent beyond 14 days if thin, which a value below 50 plays."""
    band = F.when(F.col("value") < 50, "thin").otherwise("dense")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", band.alias("band"))
    return history.silence(rows, ["user_id", "event_type"], "ts", band="band").where("last_prior is not null").select("event_id", "prior_count", "gap_days", "silent")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
    f AS (SELECT user_id, i, t AS opened, 1 AS n FROM e WHERE i = 1 UNION ALL
      SELECT e.user_id, e.i, CASE WHEN e.t < f.opened + 21600000000 THEN f.opened ELSE e.t END, CASE WHEN e.t < f.opened + 21600000000 THEN f.n + 1 ELSE 1 END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
    SELECT user_id, make_timestamp(opened) AS opened, CAST(max(n) AS INT) AS n, CAST(greatest(0, max(n) - 2) AS INT) AS n_refused FROM f GROUP BY user_id, opened"""
)
def q25_fixed_window_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour rate windows that open at the first hit after the last one's end; two hits pass."""
    return history.rate_windows(table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts", 6 * 3600, 2)


_LISTED = """listed AS (SELECT o_orderkey AS id, c_mktsegment AS subscription, CASE WHEN n_name IN ('CANADA', 'NATION_3') OR c_nationkey = 3 THEN 2 WHEN n_regionkey = 1 THEN 1 ELSE 0 END AS nexus, o_orderdate AS created_at, o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus <> 'P' AND c_acctbal >= 0)"""


@query(f"WITH {_LISTED}, r AS (SELECT *, row_number() OVER (PARTITION BY subscription ORDER BY nexus DESC, created_at DESC, id) AS k FROM listed) SELECT subscription, CAST(k AS INT) AS k, id, CAST(nexus AS INT) AS nexus FROM r WHERE k <= 50")
def q26_outbox_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subscription's first 50 records: nexus, then newest; partial and overdrawn ones are filtered before."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    nexus = F.when(F.col("n_name").isin("CANADA", "NATION_3") | (F.col("c_nationkey") == 3), 2).when(F.col("n_regionkey") == 1, 1).otherwise(0)
    rows = rows.select(F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("subscription"), nexus.alias("nexus"), F.col("o_orderdate").alias("created_at"))
    order = Window.partitionBy("subscription").orderBy(F.desc("nexus"), F.desc("created_at"), "id")
    return rows.withColumn("k", F.row_number().over(order)).where("k <= 50").select("subscription", "k", "id", "nexus")


_ESC = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"WITH t AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k FROM documents) SELECT CAST(k AS INT) AS k, '<item><title>' || {_ESC.format('source')} || '</title><description>' || {_ESC.format('substr(text, 1, 200)')} || '</description></item>' AS item FROM t WHERE k <= 50")
def q29_feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed of the 50 longest documents, escaped."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.substring("text", 1, 200).alias("head"))
    return history.feed(rows, F.col("source"), F.col("head"), [F.desc("n_chars"), F.col("doc_id")])


@query("SELECT doc_id, left(sha256(text), 16) AS source_hash FROM documents")
def q30_audit_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit hash of every text."""
    return table(spark, sf_dir, "documents").select("doc_id", history.source_hash(F.col("text")).alias("source_hash"))
