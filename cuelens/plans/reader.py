"""Queries of what readers see. Orders play records, conversations drafted briefings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelens.functions.dates import as_of
from cuelens.functions.text import held
from cuelens.lexicon.mandarin import RELATIVE_DATES
from cuelens.operators import crossing, decisions, gate, reading
from cuelens.plans.registry import query, spread, table
from cuelens.plans.screening import channel, texts

_DESKS = "[" + ", ".join(f"'{d}'" for d in (*reading.DESK_ORDER, "odd")) + "]"
_RECORDS = f"""recs AS (SELECT o_orderkey AS id, o_orderdate AS created_at, CASE WHEN o_orderstatus = 'P' THEN 'fixture_demo' ELSE 'live' END AS provenance,
  CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey % 5 <> 0 END AS adopted, o_orderkey % 11 = 0 AS personnel, {_DESKS}[1 + o_custkey % 7] AS desk,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 3 WHEN '2' THEN 2 WHEN '3' THEN 1 ELSE 0 END AS g FROM orders),
  seen AS (SELECT * FROM recs WHERE provenance <> 'fixture_demo' AND coalesce(adopted, true) AND NOT personnel)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records: status plays provenance, the customer's number adoption and desk, priority the grade."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    desks = F.array(*map(F.lit, (*reading.DESK_ORDER, "odd")))
    grade = F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1))
    return rows.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "P", "fixture_demo").otherwise("live").alias("provenance"),
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey") % 5 != 0).alias("adopted"), F.when(F.col("o_orderkey") % 11 == 0, F.array(F.lit(reading.SUBNATIONAL))).alias("drivers"),
        F.get(desks, (F.col("o_custkey") % 7).cast("int")).alias("desk"), grade.alias("grade"),
    )


@query(f"WITH {_RECORDS}, r AS (SELECT desk, id, row_number() OVER (PARTITION BY desk ORDER BY g DESC, created_at DESC, id) AS k FROM seen) SELECT desk, CAST(k AS INT) AS k, id FROM r WHERE k <= 20")
def q42_desk_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader sees of each desk: the three default filters, then grade, then the newest; the first 20."""
    w = Window.partitionBy("desk").orderBy(*reading.listing_order(by_grade=True))
    return reading.visible(records(spark, sf_dir)).withColumn("k", F.row_number().over(w)).where("k <= 20").select("desk", "k", "id")


@query(f"WITH {_RECORDS} SELECT desk, count(*) AS n FROM seen GROUP BY desk")
def q43_desk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible records of each desk."""
    return reading.desk_counts(reading.visible(records(spark, sf_dir)))


_DATED = """dated AS (SELECT o_orderkey AS id, left(o_orderpriority, 1) AS p, CAST(o_orderdate AS DATE) AS d, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-09-01') AS age, o_custkey % 3 AS n FROM orders),
  aso AS (SELECT id, n, CASE p WHEN '4' THEN NULL WHEN '5' THEN DATE '2001-08-31' ELSE d END AS date, CASE p WHEN '4' THEN 'none' WHEN '5' THEN 'relative' WHEN '1' THEN 'wire' ELSE 'absolute' END AS method,
    CASE p WHEN '4' THEN 'none' WHEN '5' THEN 'relative' ELSE 'day' END AS prec, CASE p WHEN '5' THEN 1 WHEN '4' THEN NULL ELSE age END AS age FROM dated)"""


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as texts with their date in them: beside a dateline's word, early, behind 130 characters, as a relative cue, or not at all, by priority."""
    day, kind = F.date_format("o_orderdate", "yyyy-MM-dd"), F.substring("o_orderpriority", 1, 1)
    text = F.when(kind == "4", "no date").when(kind == "5", "昨日消息").when(kind == "3", F.concat(F.repeat(F.lit("x "), 65), day, F.lit(" 2001-02-30"))).otherwise(F.concat(F.lit("of 2001-13-01, "), F.when(kind == "1", "记者 ").otherwise("and "), day, F.lit(", 1995-05-05")))
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"), narrow=True)
    rows = rows.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3).alias("n"), text.alias("text"))
    clock = F.lit("2001-09-01").cast("date")
    rows = held(rows, "as_of", as_of(F.col("text"), RELATIVE_DATES, clock))
    return rows.withColumn("age_days", F.datediff(clock, F.col("as_of.date")))


@query(f"WITH {_DATED} SELECT id, date, method, CAST(age AS INT) AS age_days, CASE WHEN prec = 'none' THEN 'unknown' WHEN prec = 'relative' THEN 'weak' WHEN age <= 7 THEN 'fresh' WHEN age <= 30 THEN 'recent' WHEN age <= 90 THEN 'aging' ELSE 'stale' END AS band FROM aso")
def q44_dates_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of date of a text, how it was found, and freshness; dates no calendar has do not count."""
    rows = dated(spark, sf_dir)
    return rows.select("id", "as_of.date", "as_of.method", "age_days", decisions.freshness(F.col("age_days"), F.col("as_of.precision")).alias("band"))


@query(
    f"""WITH {_DATED}, q AS (SELECT id, n >= 1 AS adopted, n < 2 AS lacks_source, prec IN ('none', 'relative') AS undated FROM aso)
    SELECT id, CASE WHEN NOT adopted THEN 'rejected' WHEN lacks_source OR undated THEN 'partial' ELSE 'complete' END AS quality,
      CASE WHEN NOT adopted THEN 'actionable_hard_detail' ELSE array_to_string(list_filter([CASE WHEN lacks_source THEN 'second_public_source' END, CASE WHEN undated THEN 'source_as_of' END], lambda x: x IS NOT NULL), ',') END AS missing FROM q"""
)
def q45_brief_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete, partial or rejected, and what is missing; the customer's number modulo 3 plays the number of sources."""
    rows = dated(spark, sf_dir).withColumns({"adopted": F.col("n") >= 1, "distinct_sources": F.col("n")})
    return decisions.brief_quality(rows).select("id", "quality", F.array_join("quality_missing", ",").alias("missing"))


_W = "CASE channel " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in crossing.CHANNEL_TIERS.items()) + " END"
_NAMES = "[" + ", ".join(f"'{k}'" for k in crossing.CHANNEL_TIERS) + "]"


@query(
    f"""WITH s AS (SELECT doc_id, lang || ':' || substr(trim(text), 1, 1) AS run, CASE WHEN CAST(substr(source, 4) AS INT) % 10 < {len(crossing.CHANNEL_TIERS)} THEN {_NAMES}[1 + CAST(substr(source, 4) AS INT) % 10] END AS channel FROM documents WHERE length(trim(text)) >= 20),
    known AS (SELECT *, {_W} AS w FROM s WHERE channel IS NOT NULL)
    SELECT run, array_to_string(t.tiers, ',') AS tiers, len(t.tiers) > 1 AS cross_tier, weakest FROM (
      SELECT run, list(channel ORDER BY pos) AS tiers, sum(n) AS n FROM (SELECT run, channel, min(doc_id) AS pos, count(*) AS n FROM known GROUP BY ALL) GROUP BY run) t
    JOIN (SELECT run, channel AS weakest FROM known QUALIFY row_number() OVER (PARTITION BY run ORDER BY w, doc_id) = 1) USING (run) WHERE t.n >= 2"""
)
def q46_channel_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel tiers that the sources of a run span, and the weakest; language and first letter are the run."""
    rows = texts(spark, sf_dir).select("doc_id", F.concat_ws(":", "lang", F.left("text", F.lit(1))).alias("run"), channel(F.col("source")).alias("channel"))
    weakest = crossing.weakest_tier(rows, "run", "doc_id").withColumnRenamed("run", "r")
    spread = crossing.tier_spread(rows, "run", "doc_id").join(weakest, F.col("run") == F.col("r"))
    return spread.select("run", F.array_join("tiers", ",").alias("tiers"), "cross_tier", "weakest")


@query(
    """WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, CASE turn % 3 WHEN 0 THEN substr(coalesce(text, ''), 1, 12) WHEN 1 THEN 'Q@' || substr(coalesce(text, ''), 1, 12) ELSE '' END AS quote FROM conversations),
    f AS (SELECT conv_id, turn, unnest([
      CASE WHEN trim(quote) <> '' AND NOT contains(text, trim(quote)) THEN 'quote-not-in-source:hard' END,
      CASE WHEN trim(quote) <> '' AND contains(text, trim(quote)) AND role = 'assistant' THEN 'quote-source-label-mismatch:soft' END,
      CASE WHEN turn % 2 = 0 THEN 'overclaim-forecast:soft' END, CASE WHEN turn % 4 = 0 THEN 'confidence-invalid:soft' END,
      CASE WHEN turn % 5 = 0 THEN 'ethics-forbidden-framing:hard' END, CASE WHEN turn % 6 <> 0 THEN 'triage-missing:soft' END]) AS x FROM c)
    SELECT split_part(x, ':', 1) AS finding, split_part(x, ':', 2) AS severity, count(*) AS n FROM f WHERE x IS NOT NULL GROUP BY ALL"""
)
def q47_claim_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the claim gate on turns as drafted briefings: quotes right, invented or under a wrong label, and claims by the turn's number."""
    text, turn = F.coalesce("text", F.lit("")), F.col("turn")
    head = F.left(text, F.lit(12))
    quote = F.when(turn % 3 == 0, head).when(turn % 3 == 1, F.concat(F.lit("Q@"), head)).otherwise("")
    label = F.when(F.col("role") == "assistant", "nobody").otherwise(F.col("role"))
    said = F.concat_ws(" ", F.when(turn % 2 == 0, "this is guaranteed to pass"), F.when(turn % 5 == 0, "by wiretap"))
    parts = [
        F.array(F.struct(F.lit("p").alias("point"), quote.alias("quote"), label.alias("source_label"))).alias("source_digest"),
        F.struct(said.alias("so_what"), F.when(turn % 4 == 0, "sure").otherwise("LOW").alias("confidence")).alias("briefing_en"),
        F.when(turn % 6 == 0, F.struct(F.lit("macro_policy").alias("primary_kind"))).alias("info_triage"),
    ]
    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("doc_id"), F.from_json(F.to_json(F.struct(*parts)), gate.BRIEFING).alias("b"), F.array(F.struct(F.col("role").alias("label"), text.alias("text"))).alias("sources"))
    return gate.findings(rows).groupBy("finding", "severity").agg(F.count("*").alias("n"))
