"""What readers and callers ask of records: listings, projections, catalogs, rendered words, search queries, portfolio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelens.functions.dialect import java
from cuelens.functions.text import bind

# Ranks of grades and of nexus flags; desks in the order they are shown in.
GRADES = {"P1": 3, "P2": 2, "P3": 1}
NEXUS = {"direct": 2, "possible": 1}
DESK_ORDER = ("hot_topics", "economy_investment", "industrial_tech", "foreign_affairs", "defense_public", "social_governance")
SUBNATIONAL = "subnational_personnel_low_priority"


def ranked(table: dict[str, int], value: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)]), value), F.lit(0))


def visible(records: DataFrame, fixtures: bool = False, not_adopted: bool = False, subnational: bool = False, desk: str | None = None) -> DataFrame:
    """Records (provenance, adopted, drivers, desk) that a reader sees; each flag lets one more kind in.

    Fixtures, records that were not adopted (a missing flag counts as adopted) and personnel below the nation are left out.
    """
    if not fixtures:
        records = records.where(~F.col("provenance").eqNullSafe("fixture_demo"))
    if not not_adopted:
        records = records.where(F.coalesce("adopted", F.lit(True)))
    if not subnational:
        records = records.where(~F.coalesce(F.array_contains("drivers", SUBNATIONAL), F.lit(False)))
    return records if desk is None else records.where(F.col("desk") == desk)


def listing_order(by_grade: bool = False) -> list[Column]:
    """By nexus, or on one desk by grade; then the newest; then the id."""
    first = ranked(GRADES, F.col("grade")) if by_grade else ranked(NEXUS, F.col("nexus"))
    return [first.desc(), F.desc("created_at"), F.col("id")]


def list_rows(records: DataFrame) -> DataFrame:
    """One flat row a record: what a list shows, with the file names of its JSON and Markdown."""
    file = lambda c: F.concat(F.lit("/outbox/briefs/"), F.try_element_at(F.split(c, r"[/\\]"), F.lit(-1)))
    return records.select(
        "id", "subscription_id", "created_at", F.col("source.label").alias("source_label"), "gate_passed", "grade", "primary_kind", "headline", "what", "desk", "quality", "confidence",
        "credibility", F.coalesce("adopted", F.lit(True)).alias("adopted"), (F.col("intake") == "defer").alias("deferred"), F.col("nexus"), "provenance",
        file(F.col("json_path")).alias("json_url"), file(F.col("markdown_path")).alias("markdown_url"),
    )


def reader_feed(rows: DataFrame, desk: str | None = None) -> DataFrame:
    """List rows of a desk, or of all, newest first."""
    return (rows if desk is None else rows.where(F.col("desk") == desk)).orderBy(F.desc("created_at"), "id")


def desk_counts(rows: DataFrame) -> DataFrame:
    return rows.where("desk is not null").groupBy("desk").agg(F.count("*").alias("n"))


def by_desk(rows: DataFrame) -> DataFrame:
    """(ord, desk, ids): ids of each desk in order, desks in the fixed order, others last under ``other``."""
    desk = F.coalesce("desk", F.lit("other"))
    order = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, d in enumerate(DESK_ORDER) for x in (d, i)]), F.col("desk")), F.lit(len(DESK_ORDER)))
    return rows.groupBy(desk.alias("desk")).agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("ord", order).select("ord", "desk", "ids").orderBy("ord", "desk")


def summary(records: DataFrame) -> DataFrame:
    """(id, payload): what is sent of a record to a subscriber, as JSON."""
    return records.select("id", F.to_json(F.struct(F.col("id"), F.col("subscription_id"), F.col("created_at").cast("string").alias("created_at"), F.col("source.label").alias("source_label"), "gate_passed", "primary_kind", "grade", "headline", "what")).alias("payload"))


def with_urls(digest: Column, sources: Column) -> Column:
    """Digest rows (point, quote, source_label) with source_url, that of the first source of their label."""
    url = lambda r: F.try_element_at(F.filter(sources, lambda s: s["label"] == r["source_label"]), F.lit(1))["url"]
    return F.transform(digest, lambda r: r.withField("source_url", url(r)))


def highlighted(text: Column, quote: Column) -> Column:
    """struct<before,hit,after> of a quote's first occurrence, or null."""
    at = F.instr(text, quote)
    return F.when((at > 0) & quote.isNotNull(), F.struct(F.left(text, at - 1).alias("before"), quote.alias("hit"), F.substring(text, at + F.length(quote), F.length(text)).alias("after")))


def judgments(prose: Column) -> Column:
    """Sentences of English prose, cut before a capital or a quotation mark only."""
    parts = F.split(F.coalesce(prose, F.lit("")), java(r"(?<=[.!?])\s+(?=[A-Z\"“])"))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def research_lead(entry: Column) -> Column:
    """struct<text,query,url> of an entry that ends in ``[search: query]``; without one, query and url are null."""
    pattern = java(r"(?i)\s*\[search:\s*([^\]]+)\]\s*$")
    query = F.nullif(F.trim(F.regexp_extract(entry, pattern, 1)), F.lit(""))
    url = F.concat(F.lit("https://www.google.com/search?q="), F.replace(F.url_encode(query), F.lit("+"), F.lit("%20")))
    return F.struct(F.when(query.isNull(), entry).otherwise(F.trim(F.regexp_replace(entry, pattern, ""))).alias("text"), query.alias("query"), url.alias("url"))


def first_object(raw: Column) -> Column:
    """The first JSON object of a noisy answer: as it is, fenced, or between the outer braces."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1)
    braced = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(text == "", "{}").when(text.startswith("{"), text).when(fenced != "", F.btrim(fenced, F.lit(" \t\r\n"))).when(braced != "", braced).otherwise(text)


# Datelines and bylines, and words that lead a search further.
DATELINE, BYLINE = r"(中新社|中新网)[^\d(（]{0,10}\d{1,2}月\d{1,2}日电\s*", r"[(（]\s*记者[^)）]*[)）]"
CRITICAL = "问题 局限性 批评 对比"
FOLLOW_UPS = (("发射|竣工|投产|下水|首飞|启用", "", "历次 频率 发射间隔"), ("会见|会晤|正式访问", "", "历年 同类 回应 对比"), ("", "named_instrument", "配套办法 实施细则 后续进展"), ("收入|GDP|增长|同比|人均", "numeric_target", "CPI 通胀 居民消费价格指数"))


def search_queries(text: Column, instrument: Column, nuggets: Column) -> Column:
    """Up to three distinct queries: the text's first 80 characters without dateline, with a document it lacks; that with critical words; that with what the nuggets suggest."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), java(DATELINE), " "), java(BYLINE), " "), java(r"\s") + "+", " "))

    def made(head: Column) -> Column:
        base = F.when(instrument.isNotNull() & ~F.contains(head, instrument), F.trim(F.concat(head, F.lit(" "), instrument))).otherwise(head)
        told = lambda p: F.exists(nuggets, lambda n: n["evidence"].rlike(p)) if p else F.lit(False)
        has = lambda k: F.exists(nuggets, lambda n: n["kind"] == k) if k else F.lit(False)
        cases = [F.when(told(pattern) | has(kind), F.lit(words)) for pattern, kind, words in FOLLOW_UPS]
        return F.when(base == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.array(base, F.concat(base, F.lit(" " + CRITICAL)), F.concat(base, F.lit(" "), F.coalesce(*cases))))))

    return bind(F.left(plain, F.lit(80)), made)


def one_of_each_url(hits: DataFrame, run: str) -> DataFrame:
    """Search hits (run, angle, pos, url, ...) once a URL, at their first angle and place."""
    w = Window.partitionBy(run, "url").orderBy("angle", "pos")
    return hits.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def likelihood_word(level: Column) -> Column:
    return F.when(level == "high", "likely").when(level == "medium", "roughly even odds").otherwise("unlikely")


def corroboration_band(score: Column) -> Column:
    return F.when(score >= 3, "strong").when(score >= 2, "moderate").when(score >= 1, "weak").otherwise("minimal")


def verdict(docs: DataFrame) -> Column:
    """The line a reader sees first, from intake, adopted, quality, band, confidence and credibility."""
    has = lambda c, before="": F.concat(F.lit(before), F.col(c)) if c in docs.columns else F.lit(None).cast("string")
    parts = F.array_compact(F.array(F.lit("Adopted"), has("quality", "brief "), has("band", "freshness "), has("confidence", "analysis confidence "), has("credibility", "source credibility ")))
    return (
        F.when(F.col("intake") == "defer", "Deferred — watch queue (no actionable hard detail yet).")
        .when(~F.coalesce("adopted", F.lit(True)), "Not adopted — no verifiable detail in this excerpt.")
        .otherwise(F.concat(F.array_join(parts, " · "), F.lit(".")))
    )


def markdown(docs: DataFrame) -> DataFrame:
    """(doc_id, markdown) of analysed rows: headline, verdict, source, then digest to open questions, or why it was not taken; details folded at the end.

    ``docs``: doc_id, source, intake, adopted, headline, what, digest, hard, analysis; quality, confidence, credibility, band, desk, grade where present.
    """
    bullet = lambda items: F.transform(items, lambda x: F.concat(F.lit("- "), x))
    empty = F.array().cast("array<string>")

    def section(title: str, lines: Column) -> Column:
        return F.when(F.size(lines) > 0, F.concat(F.array(F.lit(f"## {title}"), F.lit("")), lines, F.array(F.lit("")))).otherwise(empty)

    one = lambda c: F.array_compact(F.array(c))
    quoted = F.transform("digest", lambda r: F.concat(F.lit("- "), r["point"], F.lit(" 「"), r["quote"], F.lit("」")))
    key = F.transform(F.slice("hard", 1, 10), lambda n: F.concat(F.lit("- **"), F.coalesce(n["value_en"], n["value"]), F.lit(":** "), n["evidence"]))

    def told(s: Column) -> Column:
        line = lambda name, field: F.concat(F.lit(f"  - {name}: "), s[field])
        return F.array_compact(F.array(F.concat(F.lit("- **["), s["likelihood"], F.lit("]** "), s["label"]), line("Horizon", "horizon"), line("Basis", "basis"), line("Trigger", "trigger"), line("Alternative", "alternative"), line("Falsifier", "falsifier")))

    scenarios = F.flatten(F.transform("analysis.scenarios", told))
    taken = F.concat(
        section("Source digest", quoted), section("What", one(F.col("what"))), section("Context", one(F.concat(F.col("analysis.label"), F.lit(" — "), F.col("analysis.background")))), section("Key facts", key),
        section("So what", one(F.col("analysis.so_what"))), section("Outlook (hypothesis)", scenarios), section("Watchpoints", bullet("analysis.watchpoints")), section("Open questions", bullet("analysis.questions")),
    )
    refused = F.when(F.col("intake") == "defer", F.array(F.lit("## Deferred — watch queue"), F.lit(""))).otherwise(F.array(F.lit("## Not adopted"), F.lit("")))
    other = F.concat(refused, one(F.col("what")), F.array(F.lit("")))
    details = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"- {n}: "), F.col(c).cast("string"))) for c, n in (("desk", "desk"), ("grade", "grade"), ("intake", "intake"), ("quality", "brief quality"), ("confidence", "analysis confidence"), ("credibility", "source credibility"), ("band", "freshness"), ("profile", "domain")) if c in docs.columns]
    fold = F.concat(F.array(F.lit("<details>"), F.lit("<summary>Analysis details</summary>"), F.lit("")), F.array_compact(F.array(*details)), F.array(F.lit(""), F.lit("</details>"), F.lit(""), F.lit("> Draft for human review · Public sources only"), F.lit("")))
    head = F.array(F.concat(F.lit("# "), F.when(F.col("adopted"), F.col("headline")).otherwise(F.col("source"))), F.lit(""), F.concat(F.lit("**"), verdict(docs), F.lit("**")), F.lit(""), F.concat(F.lit("Source: "), F.col("source")), F.lit(""))
    return docs.select("doc_id", F.array_join(F.concat(head, F.when(F.col("adopted"), taken).otherwise(other), fold), "\n").alias("markdown"))


def portfolio(records: DataFrame, shown: int = 4) -> DataFrame:
    """(ord, desk, n_items, max_band, items): desks in the fixed order, each with its ``shown`` first records by id."""
    w = Window.partitionBy("desk").orderBy("id")
    top = records.withColumn("_k", F.row_number().over(w))
    item = F.when(F.col("_k") <= shown, F.struct("id", "primary_kind", "grade", corroboration_band(F.col("corroboration")).alias("band"), F.left("what", F.lit(120)).alias("what")))
    found = top.groupBy("desk").agg(F.count("*").alias("n_items"), corroboration_band(F.max("corroboration")).alias("max_band"), F.array_sort(F.collect_list(item)).alias("items"))
    order = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, d in enumerate(DESK_ORDER) for x in (d, i)]), F.col("desk")), F.lit(len(DESK_ORDER)))
    return found.withColumn("ord", order).select("ord", "desk", "n_items", "max_band", "items").orderBy("ord", "desk")


def pairs(items: DataFrame) -> DataFrame:
    """(section, direction, instrument): each section's first direction item, without an instrument if there is one, and first instrument item; differing ones only.

    ``items``: section, id, ord, meeting, instrument (flags), role.
    """
    meeting, document = F.col("meeting"), F.col("instrument")
    pure = F.min(F.when(meeting & ~document, F.struct("ord", "id")))
    any_ = F.min(F.when(meeting | (F.col("role") == "direction_meeting"), F.struct("ord", "id")))
    papers = F.min(F.when(document | (F.col("role") == "implementing_instrument"), F.struct("ord", "id")))
    found = items.groupBy("section").agg(F.coalesce(pure, any_).alias("d"), papers.alias("i"))
    return found.where("d.id <> i.id").select("section", F.col("d.id").alias("direction"), F.col("i.id").alias("instrument"))


def pair_gain(found: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``found`` pairs with before_max, before_min, after_score, rose, reinforced; ``before`` (id, score), ``after`` (section, score) of the merged pair."""
    a, b = (before.select(F.col("id").alias(f"{k}_id"), F.col("score").alias(f"{k}_score")) for k in ("a", "b"))
    rows = found.join(a, F.col("direction") == F.col("a_id")).join(b, F.col("instrument") == F.col("b_id")).join(after.select(F.col("section").alias("s"), F.col("score").alias("after_score")), F.col("section") == F.col("s"))
    high, low = F.greatest("a_score", "b_score"), F.least("a_score", "b_score")
    return rows.select("section", "direction", "instrument", high.alias("before_max"), low.alias("before_min"), "after_score", (F.col("after_score") > high).alias("rose"), ((low < 2) & (F.col("after_score") >= 2)).alias("reinforced"))


def catalog(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A catalog, tiers, channels, themes, profiles or cards, as a small table in its order."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"ord int, {columns}")


def safe_name(name: Column) -> Column:
    """The file name if it names a file of its folder and nothing else, or null."""
    return F.when(name.rlike(r"^[A-Za-z0-9._-]+\z") & ~name.isin(".", ".."), name)


def prompt(cards: DataFrame, order: str = "name") -> DataFrame:
    """(prompt): bodies of cards under their names, in order; a catalog's cards fit one row."""
    piece = F.struct(F.col(order).alias("o"), F.concat(F.lit("### "), "name", F.lit("\n"), "body").alias("p"))
    return cards.agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["p"]), "\n\n").alias("prompt"))
