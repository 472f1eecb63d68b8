"""Queries on collected material: pages, hosts, subscriptions, merged turns, placeholders, digests. Inline rows are stated in both forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelens.functions.dialect import literal
from cuelens.functions.text import SENTENCE_MOST, around, around_sql, placeholders, spans
from cuelens.lexicon import CORPUS
from cuelens.operators import history
from cuelens.plans.registry import query, spread, table
from cuelens.sources import feeds

_HTML = "coalesce(html, '')"
for _p in (r"(?s)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"<[^>]*>"):
    _HTML = f"regexp_replace({_HTML}, {literal(_p)}, ' ', 'g')"
for _e, _c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, {literal(_e)}, {literal(_c)})"
_HTML = f"trim(regexp_replace({_HTML}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"


@query(f"SELECT page_id, url, sha256(substr({_HTML}, 1, 20000)) AS text_sha256, CAST(length(substr({_HTML}, 1, 20000)) AS INT) AS n_chars FROM pages WHERE length({_HTML}) >= 20")
def q31_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of landed pages; the cut at 20,000 characters is the collector's."""
    return feeds.page_rows(table(spark, sf_dir, "pages")).select("page_id", "url", F.sha2("text", 256).alias("text_sha256"), F.length("text").alias("n_chars"))


HOSTS = ("ththre.example.com", "m.ththth.example.net", "the.example.org", "WWW.Example.Com")


@query(f"SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages WHERE lower(regexp_extract(url, '^https?://([^/:?#@]+)([/:?#]|$)', 1)) IN ({', '.join(literal(h.lower()) for h in HOSTS)}) OR regexp_matches(lower(regexp_extract(url, '^https?://([^/:?#@]+)', 1)), '\\.org$')")
def q32_host_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages on allowed hosts: those listed, and all .org hosts that occur; credentials and private addresses go."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = spark.createDataFrame([(h,) for h in HOSTS], "host string")
    org = pages.select(feeds.host(F.col("url")).alias("host")).where(F.col("host").endswith(".org")).distinct()
    return feeds.allowed(pages, listed.unionByName(org)).select("page_id", F.try_parse_url(F.col("url"), F.lit("HOST")).alias("host"))


SUBSCRIPTIONS = [("s1", ["idiot", "clown"], ["src3", "src1"], 5, True), ("s2", [], ["src2", "src9", "src0"], 4, None), ("s3", ["###"], ["src5"], 3, True), ("s4", ["the"], ["src7"], 10, False)]
_SUBS = ", ".join(f"({literal(i)}, [{', '.join(map(literal, k))}]::VARCHAR[], [{', '.join(map(literal, s))}], {m})" for i, k, s, m, a in SUBSCRIPTIONS if a is not False)


@query(
    f"""WITH subs(id, words, sources, most) AS (VALUES {_SUBS}), w AS (SELECT id, words, most, unnest(sources) AS source_id, unnest(range(len(sources))) AS source_pos FROM subs),
    r AS (SELECT id, doc_id, source_id, most, row_number() OVER (PARTITION BY id ORDER BY source_pos, doc_id) AS k FROM w JOIN documents ON source = source_id WHERE len(words) = 0 OR list_bool_or(list_transform(words, lambda x: contains(text, x))))
    SELECT id, CAST(k AS INT) AS k, source_id, doc_id AS item_pos FROM r WHERE k <= most"""
)
def q33_subscription_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each active subscription's items: sources in order, keywords first, then the budget."""
    subs = spark.createDataFrame(SUBSCRIPTIONS, "id string, keywords array<string>, sourceIds array<string>, maxItemsPerRun int, active boolean")
    items = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("item_pos"), "text")
    return feeds.collect(subs.where(F.coalesce("active", F.lit(True))), items).select("id", "k", "source_id", "item_pos")


@query("SELECT conv_id, count(*) AS n_items, sha256(string_agg('[' || role || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS merged_sha256 FROM conversations GROUP BY conv_id")
def q34_merge_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation merged in order under their roles."""
    rows = history.merge_texts(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role"), "text")
    return rows.select("conv_id", "n_items", F.sha2("merged", 256).alias("merged_sha256"))


LABELS = ("Alpha", "paste-1 $1", "Gamma")
_LABELS = "[" + ", ".join(map(literal, LABELS)) + "]"


@query(
    f"""WITH t AS (SELECT conv_id, turn, 'paste-' || turn || ' said ' || role || ' before paste-2, paste-' || (turn + 2) || '.' AS s FROM conversations),
    p AS (SELECT conv_id, turn, string_split_regex(s, 'paste-\\d+') AS gaps, regexp_extract_all(s, 'paste-(\\d+)', 1) AS ns FROM t)
    SELECT conv_id, turn, list_aggregate(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || CASE WHEN i > len(ns) THEN '' WHEN CAST(ns[i] AS INT) BETWEEN 1 AND 3 THEN {_LABELS}[CAST(ns[i] AS INT)] ELSE 'paste-' || ns[i] END), 'string_agg', '') AS line FROM p"""
)
def q35_placeholder_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders replaced by labels in one pass: labels that look like placeholders stay."""
    turn = F.col("turn").cast("string")
    line = F.concat(F.lit("paste-"), turn, F.lit(" said "), "role", F.lit(" before paste-2, paste-"), (F.col("turn") + 2).cast("string"), F.lit("."))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("s"))
    return rows.select("conv_id", "turn", placeholders(F.col("s"), F.array(*map(F.lit, LABELS))).alias("line"))


_CUE, _ENDS = CORPUS.themes[0].pattern, r".!?\n"


@query(
    f"""WITH s AS (SELECT doc_id, text, string_split_regex(text, {literal(_CUE)}) AS gaps, regexp_extract_all(text, {literal(_CUE)}) AS ms FROM documents),
    p AS (SELECT doc_id, text, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: length(array_to_string(gaps[1:i], '')) + length(array_to_string(ms[1:i - 1], '')))) AS st FROM s WHERE len(ms) > 0),
    q AS (SELECT doc_id, st, {around_sql("text", "st", "m", _ENDS, SENTENCE_MOST)} AS quote FROM p),
    d AS (SELECT doc_id, quote, min(st) AS st FROM q GROUP BY ALL)
    SELECT doc_id, quote, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY st) AS INT) AS k FROM d"""
)
def q37_digest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences around each cue, once, in order of their first cue; 96 characters at most."""
    quotes = F.transform(spans(F.col("text"), _CUE), lambda s: around(F.col("text"), s["start"], s["value"], _ENDS, SENTENCE_MOST))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = docs.select("doc_id", F.posexplode_outer(F.array_distinct(quotes)).alias("at", "quote")).where("at is not null")
    return rows.select("doc_id", "quote", (F.col("at") + 1).alias("k"))
