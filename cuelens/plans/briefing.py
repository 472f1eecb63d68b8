"""Mandarin briefings: the whole chain with the Mandarin pack over notices that customers' rows fill in.

A customer's number chooses one of five forms of notice; nation and balance choose its body, document, subject, amount, year
and month. What a notice states is known from the row, so the SQL says from the columns which facts must be found, where, and how
they read in English.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelens.functions.dates import as_of
from cuelens.functions.dialect import literal
from cuelens.functions.scratch import kept
from cuelens.functions.text import held
from cuelens.lexicon import MANDARIN
from cuelens.lexicon.mandarin import RELATIVE_DATES
from cuelens.lexicon.policy import THEMES
from cuelens.operators import analysis, decisions, facts, reading, scoring, substance
from cuelens.plans.registry import query, spread, table

#: What notices are filled in with, and the English of each.
BODIES = (("商务部", "the Ministry of Commerce"), ("外交部", "the Ministry of Foreign Affairs"), ("国务院办公厅", "the State Council General Office"), ("工业和信息化部", "the Ministry of Industry and Information Technology"))
PAPERS = (("通知", "a notice"), ("公告", "an announcement"), ("行动计划", "an action plan"))
SUBJECTS = (("半导体", "semiconductors"), ("芯片", "chips"))
FUNDS = (("专项资金", "special funds"), ("财政资金", "fiscal funds"))
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
FORMS = 5


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, text, url) of every customer."""
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"))
    pick = lambda of, n: F.get(F.array(*[F.lit(x[0]) for x in of]), (n % len(of)).cast("int"))
    nation, tenths = F.col("c_nationkey"), (F.floor(F.abs("c_acctbal")) % 990 + 10).cast("int")
    body, paper, subject, fund = (pick(of, nation) for of in (BODIES, PAPERS, SUBJECTS, FUNDS))
    amount = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    year, month = (2026 + nation % 3).cast("string"), (1 + nation % 12).cast("string")
    texts = [
        F.concat(body, F.lit("印发"), paper, F.lit("，安排"), fund, amount, F.lit("亿元支持"), subject, F.lit("试点，"), year, F.lit("年底前完成，严禁挪用资金。")),
        F.lit("会议强调，要坚持稳中求进，推动高质量发展，抓好各项工作落实，凝心聚力再创辉煌。"),
        F.lit("网传某地将出台新的补贴政策，博主称消息未证实，请大家耐心等待正式的消息。"),
        F.concat(body, F.lit("发布稀土管理条例，有关单位抓紧落实，一律不得超额开采，自"), year, F.lit("年"), month, F.lit("月起施行。")),
        F.lit("加拿大与中方代表会晤，双方就菜籽贸易交换了意见，强调建设性对话的重要性。"),
    ]
    form = F.col("c_custkey") % FORMS
    source = F.when(form == 2, "微博转述").otherwise(F.concat(F.lit("样例"), F.col("c_custkey").cast("string")))
    rows = held(rows.withColumn("source", source), "text", F.get(F.array(*texts), form.cast("int")))
    return rows.select(F.col("c_custkey").alias("doc_id"), "source", "text", F.lit(None).cast("string").alias("url"))


#: Rows of one text that a task reads together; those of a text with more are dealt to several.
MANY = 10_000


def each_text_once(rows: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` (doc_id, ``keys`` without nulls, more) with the columns that ``work`` adds to its rows of the distinct ``keys``.

    What depends on ``keys`` alone is done once for all rows that are equal in them.
    """
    rows = kept(rows, "said")
    counted = kept(rows.groupBy(*keys).agg(F.count("*").alias("_n")), "counted")
    done = kept(work(spread(counted.select(*keys))), "read")
    deals = counted.where(F.col("_n") > MANY).select(*keys, F.ceil(F.col("_n") / MANY).cast("int").alias("_deals"))
    place = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("_deals")).cast("int"), F.lit(0))
    left = rows.join(deals, keys, "left").withColumn("_deal", place).drop("_deals")
    right = done.join(deals, keys, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.coalesce("_deals", F.lit(1)) - 1))).drop("_deals")
    return left.join(right.hint("merge"), [*keys, "_deal"]).drop("_deal")


def classed(rows: DataFrame) -> DataFrame:
    """Normalised rows with the class of their text and source."""
    return substance.normalise(rows).withColumn("source_class", scoring.source_class(F.col("text"), MANDARIN, label=F.col("source")))


def layers(rows: DataFrame) -> DataFrame:
    """Every layer on (text, source_class): nexus, scorecard, triage, desk, substance, adoption, intake, facts."""
    rows = scoring.nexus(rows, MANDARIN)
    rows = scoring.desks(scoring.triage(scoring.scorecard(rows, MANDARIN), MANDARIN), MANDARIN)
    rows = substance.cut(kept(facts.facts(rows), "facts"), MANDARIN)
    return decisions.intake(decisions.adoption(rows, MANDARIN), MANDARIN)


def brief(rows: DataFrame) -> DataFrame:
    """``layers`` of (doc_id, source, text)."""
    return layers(kept(classed(rows), "texts"))  # a text that is still an expression would be made anew for each rule


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else literal(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _named(name: str, of) -> str:
    """A table (place, Mandarin, English) of what notices are filled in with."""
    return f"{name}(k, zh, en) AS (VALUES {_values([(i, *x) for i, x in enumerate(of)])})"


_NOTICES = f"""{_named('bodies', BODIES)}, {_named('papers', PAPERS)}, {_named('topics', SUBJECTS)}, {_named('funds', FUNDS)},
  filled AS (
    SELECT CAST(c_custkey AS BIGINT) AS doc_id, c_custkey % {FORMS} AS form, b.zh AS body, b.en AS body_en, p.zh AS paper, p.en AS paper_en, t.zh AS topic, t.en AS topic_en, f.zh AS fund, f.en AS fund_en,
      CAST(floor(abs(c_acctbal)) AS BIGINT) % 990 + 10 AS tenths, CAST(2026 + c_nationkey % 3 AS VARCHAR) AS y, 1 + c_nationkey % 12 AS m
    FROM customer JOIN bodies b ON c_nationkey % {len(BODIES)} = b.k JOIN papers p ON c_nationkey % {len(PAPERS)} = p.k JOIN topics t ON c_nationkey % {len(SUBJECTS)} = t.k JOIN funds f ON c_nationkey % {len(FUNDS)} = f.k),
  said AS (
    SELECT *, (tenths // 10) || '.' || (tenths % 10) AS shown, length(body) AS lb, length(body) + 2 + length(paper) + 3 + length(fund) AS la,
      'RMB ' || CASE WHEN tenths >= 100 THEN regexp_replace(CAST(CAST(tenths / 100.0 AS DECIMAL(9, 2)) AS VARCHAR), '[.]?0+$', '') || ' billion' ELSE (tenths * 10) || ' million' END AS yuan FROM filled),
  rules AS (
    SELECT doc_id, unnest([
      {{'kind': 'actor', 'start': 0, 'value': body, 'value_en': body_en, 'amount': NULL}}, {{'kind': 'instrument', 'start': lb + 2, 'value': paper, 'value_en': paper_en, 'amount': NULL}},
      {{'kind': 'money', 'start': la, 'value': shown || '亿元', 'value_en': yuan || ' in ' || fund_en, 'amount': tenths * 1e7}},
      {{'kind': 'scope', 'start': la + length(shown) + 4, 'value': topic || '试点', 'value_en': 'a ' || topic_en || ' pilot', 'amount': NULL}}, {{'kind': 'subject', 'start': la + length(shown) + 4, 'value': topic, 'value_en': topic_en, 'amount': NULL}},
      {{'kind': 'deadline', 'start': la + length(shown) + length(topic) + 7, 'value': y || '年底前', 'value_en': 'by end-' || y, 'amount': NULL}},
      {{'kind': 'prohibition', 'start': la + length(shown) + length(topic) + 17, 'value': '严禁挪用资金', 'value_en': 'expressly prohibits a practice named only in the Mandarin excerpt', 'amount': NULL}}]) AS f FROM said WHERE form = 0
    UNION ALL SELECT doc_id, {{'kind': 'money', 'start': 9, 'value': '补贴', 'value_en': 'subsidies (no amount stated)', 'amount': NULL}} FROM said WHERE form = 2
    UNION ALL SELECT doc_id, unnest([
      {{'kind': 'actor', 'start': 0, 'value': body, 'value_en': body_en, 'amount': NULL}}, {{'kind': 'actor', 'start': lb + 9, 'value': '有关单位', 'value_en': 'unnamed “relevant units”', 'amount': NULL}},
      {{'kind': 'instrument', 'start': lb + 2, 'value': '稀土管理条例', 'value_en': 'a rare earths regulation', 'amount': NULL}}, {{'kind': 'subject', 'start': lb + 2, 'value': '稀土', 'value_en': 'rare earths', 'amount': NULL}},
      {{'kind': 'prohibition', 'start': lb + 18, 'value': '一律不得超额开采', 'value_en': 'flatly bars a practice named only in the Mandarin excerpt', 'amount': NULL}},
      {{'kind': 'deadline', 'start': lb + 27, 'value': '自' || y || '年' || m || '月起', 'value_en': 'from ' || [{', '.join(map(literal, MONTHS))}][m] || ' ' || y, 'amount': NULL}}]) FROM said WHERE form = 3
    UNION ALL SELECT doc_id, unnest([{{'kind': 'subject', 'start': 0, 'value': '加拿大', 'value_en': 'Canada', 'amount': NULL}}, {{'kind': 'subject', 'start': 14, 'value': '菜籽', 'value_en': 'canola', 'amount': NULL}}]) FROM said WHERE form = 4)"""


@query(f"WITH {_NOTICES} SELECT doc_id, f.kind AS kind, CAST(f.start AS INT) AS start, f.value AS value, f.value_en AS value_en, CAST(f.amount AS DOUBLE) AS amount FROM rules")
def q38_facts_mandarin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed facts of all notices with their places, English and amounts, against what each row filled in."""
    rows = each_text_once(substance.normalise(notices(spark, sf_dir)), ["text"], lambda texts: facts.facts(texts).select("text", "facts"))
    rows = rows.select("doc_id", F.explode("facts").alias("f"))
    return rows.select("doc_id", "f.kind", "f.start", "f.value", "f.value_en", F.col("f.amount").cast("double").alias("amount"))


def read(rows: DataFrame, now: str = "2026-06-01") -> DataFrame:
    """``brief`` and all that a reader sees: date and freshness, quality, profile, analysis, headline, prose, digest. The clock is ``now``.

    All of it follows from a text and its class, so equal texts of a class are read once.
    """
    return each_text_once(classed(rows), ["text", "source_class"], lambda texts: read_texts(texts, now))


def read_texts(rows: DataFrame, now: str) -> DataFrame:
    """``read`` of (text, source_class)."""
    clock = F.lit(now).cast("date")
    rows = kept(held(scoring.policy_overlay(layers(rows), THEMES), "as_of", as_of(F.col("text"), RELATIVE_DATES, clock)), "briefs")
    age = F.datediff(clock, F.col("as_of.date"))
    rows = rows.withColumns({"band": decisions.freshness(age, F.col("as_of.precision")), "distinct_sources": F.lit(1)})
    rows = analysis.analyse(analysis.pick(decisions.brief_quality(rows)))
    scenarios = decisions.clamp_scenarios(F.col("analysis.scenarios"), F.col("band"))
    watch = analysis.watchpoints(F.col("analysis.watchpoints"), F.col("band"), F.col("as_of.date"))
    rows = rows.withColumn("analysis", F.col("analysis").withField("scenarios", scenarios).withField("watchpoints", watch))
    told = F.when(F.col("adopted"), facts.what()).otherwise(facts.rejection())
    return rows.withColumns({"headline": facts.headline(F.col("hard")), "what": told, "digest": facts.digest(), "missing": facts.missing_facts()})


#: What each form of notice comes to, whatever it is filled in with; the first one's class is that of its document, else of its body.
DECISIONS = [
    (0, "dense", "medium", None, "implementing_instrument", "hot_topics", "P3", "none", "none", "semiconductors", "partial", "admit"),
    (1, "thin", "medium", "unknown_public", "macro_policy", "economy_investment", "P4", "none", "none", "macro_finance", "rejected", "reject_thin"),
    (2, "thin", "medium", "social_commentary", "other_public_text", "economy_investment", "P4", "none", "none", "macro_finance", "rejected", "social_downweight"),
    (3, "dense", "medium", "policy_instrument", "implementing_instrument", "hot_topics", "P3", "possible", "topical", "critical_minerals", "partial", "admit"),
    (4, "dense", "medium", "unknown_public", "implementing_instrument", "economy_investment", "P2", "direct", "topical", "canada_trade", "partial", "admit"),
]
_DECIDED = "substance_band, signal_band, source_class, primary_kind, desk, grade, nexus, policy_level, profile, quality, intake"


@query(
    f"""WITH {_NOTICES} SELECT doc_id, {_DECIDED.replace("source_class", "coalesce(source_class, CASE WHEN paper = '通知' THEN 'policy_instrument' WHEN body = '工业和信息化部' THEN 'unknown_public' ELSE 'official_or_wire' END) AS source_class")}
    FROM said JOIN (VALUES {_values(DECISIONS)}) t(form, {_DECIDED}) USING (form)"""
)
def q40_mandarin_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands, class, desk, grade, nexus, policy, profile, quality and intake of all notices: what is filled in must not change them."""
    return read(notices(spark, sf_dir)).select("doc_id", *_DECIDED.split(", "))


@query()
def q41_brief_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Briefings of all notices as Markdown."""
    return reading.markdown(read(notices(spark, sf_dir)))
