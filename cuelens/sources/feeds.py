"""Collecting: whitelists, subscriptions, hosts, item budgets, feeds. Nothing is fetched; landed rows are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelens.functions.markup import html_text, rss_items

ENTRY = "struct<id:string,type:string,path:string,url:string,label:string,topics:array<string>,enabled:boolean,note:string,maxItems:int,tier:string,channel_type:string,authority_weight:double>"
SUBSCRIPTION = (
    "struct<id:string,title:string,description:string,keywords:array<string>,sourceIds:array<string>,scheduleCron:string,scheduleHuman:string,"
    "delivery:array<string>,forceOffline:boolean,maxItemsPerRun:int,mergeMode:string,active:boolean>"
)
TEXT_MOST, TEXT_LEAST = 20_000, 20


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """One row an enabled entry, in file order."""
    file = spark.read.schema(f"version int, allowedHosts array<string>, entries array<{ENTRY}>").option("multiLine", True).json(path)
    rows = file.select("allowedHosts", F.posexplode("entries").alias("ord", "e")).select("ord", "allowedHosts", "e.*")
    return rows.where(F.coalesce("enabled", F.lit(True)))


def read_subscriptions(spark: SparkSession, path: str) -> DataFrame:
    """Active subscriptions; one without the flag is active. Schedules are carried along for whatever starts the runs."""
    file = spark.read.schema(f"version int, subscriptions array<{SUBSCRIPTION}>").option("multiLine", True).json(path)
    return file.select(F.explode("subscriptions").alias("s")).select("s.*").where(F.coalesce("active", F.lit(True)))


def host(url: Column) -> Column:
    """Lower-cased host without port."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def allowed(urls: DataFrame, hosts: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` on an allowed host (or a subdomain of none): http or https, without credentials, not a private address."""
    safe = F.col(url).rlike("^https?://") & F.try_parse_url(F.col(url), F.lit("USERINFO")).isNull()
    private = host(F.col(url)).rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|\[)")
    known = hosts.select(F.lower("host").alias("_host")).distinct()
    return urls.where(safe & ~private).join(known, host(F.col(url)) == F.col("_host"), "left_semi")


def keyword_match(text: Column, keywords: Column) -> Column:
    """True if any keyword occurs; an empty or missing list lets all pass."""
    return (F.coalesce(F.size(keywords), F.lit(0)) <= 0) | F.exists(keywords, lambda k: F.contains(text, k))


def collect(subscriptions: DataFrame, items: DataFrame) -> DataFrame:
    """Items of each subscription's sources in order, keyword-filtered, then cut to its budget.

    ``items``: source_id, item_pos, text. The budget counts what the filter leaves.
    """
    wanted = subscriptions.select("id", "keywords", F.coalesce("maxItemsPerRun", F.lit(3)).alias("most"), F.posexplode("sourceIds").alias("source_pos", "want"))
    rows = wanted.join(items, F.col("want") == F.col("source_id")).where(keyword_match(F.col("text"), F.col("keywords")))
    order = Window.partitionBy("id").orderBy("source_pos", "item_pos")
    return rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= F.col("most")).select("id", "k", "source_id", "item_pos", "text")


def rss_rows(feeds: DataFrame, most: int = 5) -> DataFrame:
    """(source_id, item_pos, title, url, text) of feeds (source_id, xml); text is title and description."""
    rows = feeds.select("source_id", F.posexplode(rss_items(F.col("xml"), most)).alias("item_pos", "i"))
    return rows.select("source_id", "item_pos", "i.title", F.col("i.link").alias("url"), F.concat_ws("\n", "i.title", "i.description").alias("text"))


def page_rows(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of landed pages, cut to ``TEXT_MOST`` characters, dropped below ``TEXT_LEAST``.

    Where ``pages`` has content_type, only HTML, XML, JSON and plain text count; text that is not HTML stays as it is.
    """
    body = F.coalesce("html", F.lit(""))
    text = html_text(body)
    if "content_type" in pages.columns:
        pages = pages.where(F.lower("content_type").rlike("^(text/(html|plain|xml)|application/(xhtml\\+xml|xml|json|rss\\+xml|atom\\+xml))"))
        text = F.when(F.lower("content_type").contains("html"), text).otherwise(F.trim(body))
    return pages.select("page_id", "url", F.substring(text, 1, TEXT_MOST).alias("text")).where(F.length("text") >= TEXT_LEAST)


def read_fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """(id, domain, label, text, file) of the JSON files of a folder, one an excerpt; short ones go, ids are file names, in their order."""
    rows = spark.read.schema("domain string, sourceLabel string, sourceText string").option("multiLine", True).json(f"{folder}/*.json")
    file = F.element_at(F.split(F.input_file_name(), "/"), -1)
    rows = rows.select(F.regexp_replace(F.url_decode(file), r"\.json$", "").alias("id"), F.coalesce("domain", F.lit("unknown")).alias("domain"), "sourceLabel", F.coalesce("sourceText", F.lit("")).alias("text"), file.alias("file"))
    return rows.select("id", "domain", F.coalesce("sourceLabel", "file").alias("label"), "text", "file").where(F.length("text") >= TEXT_LEAST).orderBy("id")


def local_rows(spark: SparkSession, whitelist: DataFrame, folder: str) -> DataFrame:
    """(source_id, item_pos, text) of a whitelist's ``local_json`` entries whose file is in ``folder``; short texts go."""
    files = read_fixtures(spark, folder).select("text", F.col("file").alias("f"))
    wanted = whitelist.where("type = 'local_json'").select(F.col("id").alias("source_id"), F.element_at(F.split("path", "/"), -1).alias("p"))
    return wanted.join(files, F.col("p") == F.col("f")).select("source_id", F.lit(0).alias("item_pos"), F.trim("text").alias("text")).where(F.length("text") >= TEXT_LEAST)


def admit(items: DataFrame) -> DataFrame:
    """Items whose enrichment (in_scope, language_quality, has_concrete_detail) says so; an unknown one is admitted."""
    ok = F.col("in_scope") & (F.col("language_quality") != "non_chinese") & F.col("has_concrete_detail")
    return items.where(F.coalesce(ok, F.lit(True)))
