"""Queries on single documents: cues, scores, classes, decisions. The corpus pack plays the lexicon.

``source`` is a document's label, and its number, modulo the channel tiers, its channel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelens.functions.dialect import literal, re2
from cuelens.functions.text import around_sql, marked, matches, seen
from cuelens.lexicon import CORPUS
from cuelens.lexicon.rules import cut_patterns, triage_patterns, values_sql
from cuelens.operators import decisions, scoring, substance
from cuelens.plans.registry import query, spread, table

_KINDS = values_sql(CORPUS.detectors)
_TEXT = "SELECT doc_id, trim(text) AS text, lang, source FROM documents WHERE length(trim(text)) >= 20"
_CASE_ACTIONABLE = " ".join(f"WHEN kind = {literal(k)} THEN {'true' if not p else f'regexp_matches(evidence, {literal(re2(p))})'}" for k, p in CORPUS.actionable.items())

#: Nuggets of every document, by rule table and not by rule column: distinct in order, 4 a kind, 16 in all; the clause
#: of each from the place of its first match.
NUGGETS_SQL = f"""
  docs AS ({_TEXT}),
  rules(ord, kind, pattern, w) AS (VALUES {_KINDS}),
  raw AS (SELECT doc_id, text, ord, kind, string_split_regex(text, pattern) AS gaps, regexp_extract_all(text, pattern) AS ms FROM docs, rules WHERE regexp_matches(text, pattern)),
  flat AS (SELECT doc_id, ord, kind, unnest(ms) AS value, unnest(range(1, len(ms) + 1)) AS pos FROM raw),
  once AS (SELECT doc_id, ord, kind, value, min(pos) AS pos FROM flat GROUP BY ALL),
  capped AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY pos) AS k FROM once QUALIFY k <= 4),
  kept AS (SELECT doc_id, ord, kind, value, pos, row_number() OVER (PARTITION BY doc_id ORDER BY ord, k) AS n FROM capped QUALIFY n <= 16),
  placed AS (SELECT kept.*, text, length(array_to_string(gaps[1:pos], '')) + length(array_to_string(ms[1:pos - 1], '')) AS st FROM kept JOIN raw USING (doc_id, ord)),
  nuggets AS (SELECT doc_id, ord, kind, value, n, {around_sql("text", "st", "value")} AS evidence FROM placed),
  scores AS (
    SELECT docs.doc_id, count(n) AS n_nuggets, least(1000, 120 * count(DISTINCT kind) + 40 * count(n)) AS milli
    FROM docs LEFT JOIN nuggets USING (doc_id) GROUP BY docs.doc_id),
  bands AS (SELECT *, CASE WHEN milli >= 450 THEN 'dense' WHEN milli >= 200 THEN 'mixed' ELSE 'thin' END AS band FROM scores)"""
_CLASS = " ".join(f"WHEN regexp_matches(text, {literal(re2(r.pattern))}) THEN {literal(c)}" for rules, names in ((CORPUS.social, ["social_commentary"] * len(CORPUS.social)), (CORPUS.classes, [r.name for r in CORPUS.classes])) for r, c in zip(rules, names, strict=True))
INTAKE_SQL = f"""{NUGGETS_SQL},
  tests AS (SELECT *, coalesce(CASE {_CASE_ACTIONABLE} ELSE false END, false) AS strong FROM nuggets),
  per AS (
    SELECT docs.doc_id, count(*) FILTER (strong) AS n_strong,
      least(2, count(*) FILTER (kind = 'responsible_body')) + least(2, count(*) FILTER (kind = 'named_sector_or_place')) AS n_support,
      count(*) FILTER (kind = 'responsible_body') > 0 AS body, count(*) FILTER (kind = 'named_sector_or_place') > 0 AS sector,
      count(*) FILTER (kind = 'constraint_or_ban') > 0 AS ban, count(*) FILTER (kind = 'timeline') > 0 AS time
    FROM docs LEFT JOIN tests USING (doc_id) GROUP BY docs.doc_id),
  classed AS (SELECT doc_id, text, lang, source, CASE {_CLASS} ELSE 'unknown_public' END AS source_class FROM docs),
  decided AS (
    SELECT doc_id, lang, source, source_class, band, milli, n_nuggets, n_strong, n_support, n_strong >= 1 AND n_strong + (n_support > 0)::INT >= 2 AS adopted,
      (body AND sector) OR (ban AND sector) OR (band = 'thin' AND regexp_matches(text, {literal(re2(CORPUS.gray))})) OR (time AND n_strong = 0) AS gray
    FROM classed JOIN per USING (doc_id) JOIN bands USING (doc_id)),
  intake AS (
    SELECT *, CASE WHEN source_class = 'social_commentary' THEN 'social_downweight' WHEN adopted THEN 'admit' WHEN gray THEN 'defer' ELSE 'reject_thin' END AS intake
    FROM decided)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised documents, over as many tasks as there are cores where the files have fewer row groups."""
    return substance.normalise(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")))


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(texts(spark, sf_dir))


def cut(rows: DataFrame) -> DataFrame:
    """Normalised documents with their nuggets and substance; each cue of a text is looked for once, for classes and the gray zone too."""
    return substance.cut(marked(rows, cut_patterns(CORPUS)), CORPUS)


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every normalised document with its cut, class, adoption and intake."""
    return screen(texts(spark, sf_dir))


def screen(rows: DataFrame) -> DataFrame:
    """``screened`` of normalised documents."""
    rows = cut(rows)
    rows = rows.withColumn("source_class", scoring.source_class(seen(rows), CORPUS))
    return decisions.intake(decisions.adoption(rows, CORPUS), CORPUS)


@query(f"SELECT doc_id, source AS label, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256 FROM ({_TEXT})")
def q01_normalise_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed texts of 20 characters or more."""
    rows = substance.normalise(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("source").alias("label"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query(r"SELECT min(doc_id) AS doc_id, sha256(regexp_replace(text, '\s+', '', 'g')) AS paste_key, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 2")
def q02_repaste_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that differ in white space alone, once."""
    return substance.one_of_each_paste(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"))


@query(
    f"""WITH docs AS ({_TEXT}), rules(ord, kind, pattern, w) AS (VALUES {_KINDS})
    SELECT kind, count(*) AS n_docs, CAST(sum(len(ms)) AS BIGINT) AS n_hits FROM (SELECT kind, regexp_extract_all(text, pattern) AS ms FROM docs, rules) WHERE len(ms) > 0 GROUP BY kind"""
)
def q03_cue_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and matches of each detector; rules are unrolled so each pattern is compiled once."""
    docs = texts(spark, sf_dir)
    counts = F.array(*[F.struct(F.lit(r.name).alias("kind"), F.size(matches(F.col("text"), r.pattern)).alias("n")) for r in CORPUS.detectors])
    rows = docs.select(F.explode(F.filter(counts, lambda c: c["n"] > 0)).alias("c"))
    return rows.groupBy(F.col("c.kind").alias("kind")).agg(F.count("*").alias("n_docs"), F.sum(F.col("c.n").cast("long")).alias("n_hits"))


@query(f"WITH {NUGGETS_SQL} SELECT doc_id, kind, value, evidence, CAST(n AS INT) AS n FROM nuggets")
def q04_nugget_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nuggets in order, each with the clause it stands in: distinct, 4 a kind, 16 a document."""
    # the outer form: an inner one would filter on the array below the projection and compute it twice
    rows = cuts(spark, sf_dir).select("doc_id", F.posexplode_outer("nuggets").alias("at", "x")).where("at is not null")
    return rows.select("doc_id", "x.kind", "x.value", "x.evidence", (F.col("at") + 1).alias("n"))


_COVERED = " + ".join(f"length(regexp_extract(text, {literal(re2(r.pattern))}))" for r in CORPUS.boilerplate)


@query(f"SELECT doc_id, CAST(least({_COVERED}, length(text)) AS INT) AS covered, round(CAST(least({_COVERED}, length(text)) AS DOUBLE) / length(text), 3) AS boilerplate_ratio FROM ({_TEXT})")
def q05_boilerplate_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a text that the first match of each stock phrase covers."""
    rows = cuts(spark, sf_dir)
    return rows.select("doc_id", substance.boilerplate(F.col("text"), CORPUS).alias("covered"), "boilerplate_ratio")


@query(f"WITH {NUGGETS_SQL} SELECT doc_id, CAST(n_nuggets AS INT) AS n_nuggets, CAST(milli AS INT) AS substance_milli, band AS substance_band FROM bands")
def q06_substance_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substance score in thousandths and band."""
    return cuts(spark, sf_dir).select("doc_id", F.size("nuggets").alias("n_nuggets"), "substance_milli", "substance_band")


@query(f"WITH {INTAKE_SQL} SELECT source, intake, count(*) AS n_docs, CAST(count(*) FILTER (adopted) AS BIGINT) AS n_adopted, CAST(sum(milli) AS BIGINT) AS milli FROM intake GROUP BY ALL")
def q07_intake_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: normalise, cut, classify, adopt and take in every document; counts by source and label."""
    rows = screened(spark, sf_dir)
    return rows.groupBy("source", "intake").agg(F.count("*").alias("n_docs"), F.count_if("adopted").alias("n_adopted"), F.sum(F.col("substance_milli").cast("long")).alias("milli"))


def _status_sql(signal) -> str:
    return "CASE " + " ".join(f"WHEN {c.sql('text')} THEN '{name}'" for name, c in signal.cases) + " ELSE 'unclear' END"


_SIGNALS = " UNION ALL ".join(f"SELECT doc_id, {literal(s.name)} AS name, {literal(s.category)} AS category, {s.weight} AS weight, {_status_sql(s)} AS status FROM docs" for s in CORPUS.signals)
_WEIGHTS = sum(s.weight for s in CORPUS.signals)
CARD_SQL = f"""
  docs AS ({_TEXT}), signals AS ({_SIGNALS}),
  card AS (
    SELECT doc_id, count(*) FILTER (status = 'hit') AS n_hit, count(*) FILTER (status = 'miss') AS n_miss, count(*) FILTER (status = 'unclear') AS n_unclear,
      sum(weight * CASE status WHEN 'hit' THEN 1000 WHEN 'unclear' THEN 400 ELSE 0 END) AS total
    FROM signals GROUP BY doc_id),
  banded AS (SELECT *, CASE WHEN total >= {550 * _WEIGHTS} THEN 'high' WHEN total >= {300 * _WEIGHTS} THEN 'medium' ELSE 'low' END AS signal_band FROM card)"""


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scorecard(texts(spark, sf_dir), CORPUS)


@query(f"WITH {CARD_SQL} SELECT doc_id, CAST(n_hit AS INT) AS n_hit, CAST(n_miss AS INT) AS n_miss, CAST(n_unclear AS INT) AS n_unclear, CAST(total AS INT) AS signal_sum, signal_band FROM banded")
def q08_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted signals, counts of each status, band by the weights' actual sum."""
    return cards(spark, sf_dir).select("doc_id", "n_hit", "n_miss", "n_unclear", "signal_sum", "signal_band")


_VALVE = "CASE WHEN bool_or(status = 'hit') FILTER (category = '{0}') THEN 'observed' WHEN bool_or(status = 'miss') FILTER (category = '{0}') THEN 'absent' ELSE 'unclear' END AS {0}"


@query(f"WITH {CARD_SQL} SELECT doc_id, {', '.join(_VALVE.format(c) for c in ('sequence', 'implementing_detail', 'press_placement'))} FROM signals GROUP BY doc_id")
def q09_valves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three valves rolled up from the signals' categories."""
    return scoring.valves(cards(spark, sf_dir)).select("doc_id", "sequence", "implementing_detail", "press_placement")


def _driver_sql() -> str:
    out = []
    for name, milli, test in CORPUS.drivers:
        if isinstance(test[0], str):
            holds = f"len(list_intersect(kinds, [{', '.join(map(literal, test))}])) > 0"
        else:
            holds = test[0].sql("text") + (f" AND len(list_intersect(kinds, [{', '.join(map(literal, test[1]))}])) = 0" if test[1] else "")
        out.append((name, milli, holds))
    return " + ".join(f"CASE WHEN {h} THEN {m} ELSE 0 END" for _, m, h in out)


_NEXUS = f"CASE WHEN {' OR '.join(f'regexp_matches(text, {literal(re2(r.pattern))})' for r in CORPUS.nexus_direct)} THEN 'direct' WHEN {' OR '.join(f'regexp_matches(text, {literal(re2(r.pattern))})' for r in CORPUS.nexus_possible)} THEN 'possible' ELSE 'none' END"
TRIAGE_SQL = f"""{CARD_SQL},
  kind_rules(ord, kind, pattern, w) AS (VALUES {values_sql(CORPUS.kinds)}),
  kind_hits AS (SELECT doc_id, kind, w, ord FROM docs, kind_rules WHERE regexp_matches(text, pattern)),
  kinded AS (
    SELECT docs.doc_id, any_value(text) AS text, any_value(lang) AS lang, any_value(source) AS source,
      coalesce(list(kind ORDER BY w DESC, ord) FILTER (kind IS NOT NULL), ['other_public_text']) AS kinds
    FROM docs LEFT JOIN kind_hits USING (doc_id) GROUP BY docs.doc_id),
  nexused AS (SELECT *, {_NEXUS} AS nexus FROM kinded),
  triage AS (
    SELECT doc_id, text, lang, source, kinds, kinds[1] AS primary_kind, nexus, signal_band,
      greatest(0, least(1000, 250 + {_driver_sql()} + CASE signal_band WHEN 'high' THEN 80 WHEN 'medium' THEN 40 ELSE 0 END + CASE WHEN total >= 50000 THEN 50 ELSE 0 END
        + CASE WHEN length(text) < 80 THEN -120 ELSE 0 END + CASE nexus WHEN 'direct' THEN 250 WHEN 'possible' THEN 120 ELSE 0 END)) AS importance
    FROM nexused JOIN banded USING (doc_id)),
  graded AS (SELECT *, CASE WHEN importance >= 750 THEN 'P1' WHEN importance >= 550 THEN 'P2' WHEN importance >= 350 THEN 'P3' ELSE 'P4' END AS grade FROM triage)"""


def triaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with scorecard, nexus, kinds, importance and grade; each cue of a text is looked for once, for desks and roles too."""
    rows = marked(texts(spark, sf_dir), triage_patterns(CORPUS))
    return scoring.triage(scoring.nexus(scoring.scorecard(rows, CORPUS), CORPUS), CORPUS)


@query(f"WITH {TRIAGE_SQL} SELECT doc_id, primary_kind, array_to_string(kinds, ',') AS kinds, CAST(importance AS INT) AS importance, grade FROM graded")
def q10_triage_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds by weight, importance in thousandths from its drivers, grade."""
    return triaged(spark, sf_dir).select("doc_id", "primary_kind", F.array_join("kinds", ",").alias("kinds"), "importance", "grade")


def _desk_sql() -> str:
    where, extra = CORPUS.extra["defense"]
    out = []
    for i, d in enumerate(CORPUS.desks):
        s = f"CASE WHEN regexp_matches(text, {literal(re2(d.pattern))}) THEN 1000 ELSE 0 END"
        if d.kinds:
            s += f" + CASE WHEN primary_kind IN ({', '.join(map(literal, d.kinds))}) THEN 1200 ELSE 0 END"
        if d.name == where:
            s += f" + CASE WHEN {extra.sql('text')} THEN 800 ELSE 0 END"
        if i == 0:
            s += " + CASE WHEN n_themes > 0 THEN 2000 + least(1500, 400 * n_themes) ELSE 0 END"
        out.append(f"SELECT doc_id, {i} AS ord, {literal(d.name)} AS desk, {s} AS score FROM themed")
    return " UNION ALL ".join(out)


_THEMES = " + ".join(f"regexp_matches(text, {literal(re2(r.pattern))})::INT" for r in CORPUS.themes)
DESK_SQL = f"""{TRIAGE_SQL},
  themed AS (SELECT *, {_THEMES} AS n_themes FROM graded),
  desk_scores AS ({_desk_sql()}),
  desk_ranks AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS k FROM desk_scores WHERE score > 0),
  desked AS (
    SELECT themed.*, coalesce(t.desk, '{CORPUS.default_desk}') AS desk, coalesce(t.score, 0) AS desk_score, coalesce(array_to_string(o.desks, ','), '') AS secondary
    FROM themed LEFT JOIN (SELECT * FROM desk_ranks WHERE k = 1) t USING (doc_id)
    LEFT JOIN (SELECT doc_id, list(desk ORDER BY k) AS desks FROM desk_ranks WHERE k IN (2, 3) GROUP BY doc_id) o USING (doc_id))"""


def desked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.desks(triaged(spark, sf_dir), CORPUS)


@query(f"WITH {DESK_SQL} SELECT doc_id, desk, secondary, CAST(desk_score AS INT) AS desk_score, CAST(n_themes AS INT) AS n_themes FROM desked")
def q11_desk_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best desk, the next two, themes; catalog order settles ties."""
    return desked(spark, sf_dir).select("doc_id", "desk", F.array_join("secondary_desks", ",").alias("secondary"), "desk_score", F.size("themes").alias("n_themes"))


#: Context cards: id, type bonus (thousandths), desks it belongs to, keywords.
CARDS = [("c01", 50, "english_desk", "the thing|hereby"), ("c02", 0, "noise_desk", "###|***"), ("c03", 100, "all", "idiot|clown|loser"), ("c04", 0, "romance_desk", "les |las "), ("c05", 50, "german_desk", "der |die |das "), ("c06", 0, "all", "Licensed|under"), ("c07", 20, "english_desk", "the |and |of "), ("c08", 0, "all", "@|http"), ("c09", 0, "all", "er|en|on"), ("c10", 10, "romance_desk", "que|de la")]
_CARDS = ", ".join(f"({literal(i)}, {b}, {literal(d)}, {literal(k)}.split('|'))" for i, b, d, k in CARDS)


@query(
    f"""WITH {DESK_SQL}, cards(card, bonus, home, words) AS (VALUES {_CARDS}),
    scored AS (SELECT doc_id, card, 400 * len(list_filter(words, lambda w: contains(text, w))) AS hits, bonus + CASE WHEN home = desk THEN 1000 WHEN home = 'all' THEN 350 ELSE 0 END AS affinity FROM desked, cards),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits + affinity DESC, card) AS k FROM scored WHERE hits > 0)
    SELECT doc_id, card, CAST(hits + affinity AS INT) AS score, CAST(k AS INT) AS k FROM ranked WHERE k <= 8"""
)
def q12_ontology_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best eight context cards of a document: keywords, desk affinity and type bonus; in the row, no join."""
    catalog = [{"id": card, "bonus": bonus, "desks": (home,), "match": words.split("|")} for card, bonus, home, words in CARDS]
    return scoring.match_cards(desked(spark, sf_dir), catalog)


_CHANNELS = list(scoring.CHANNEL_TIERS)
_CHANNEL_SQL = "CASE CAST(substr(source, 4) AS INT) % 10 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(scoring.CHANNEL_TIERS.values())) + " ELSE 30 END"


def channel(source: Column) -> Column:
    """Channel tier of a driver source by its number; every tenth is not listed."""
    return F.try_element_at(F.array(*map(F.lit, _CHANNELS)), F.substring(source, 4, 9).cast("int") % 10 + 1)


def credible(rows: DataFrame) -> DataFrame:
    """``rows`` (text, source, source_class) with tiers, provenance and credibility."""
    rows = rows.withColumn("source_tier", scoring.source_tier(F.col("text"), F.col("source_class"), CORPUS))
    rows = rows.withColumns({
        "tier_weight": scoring.tier_weight(F.col("source_tier")),
        "channel_weight": scoring.channel_weight(channel(F.col("source"))),
        "provenance": F.when(F.col("source").rlike("[05]$"), "adequate").otherwise("weak"),
    })
    return decisions.credibility(rows)


_TIER_SQL = "CASE source_class WHEN 'social_commentary' THEN 'D' WHEN 'policy_instrument' THEN 'A' WHEN 'official_or_wire' THEN 'B' WHEN 'press_commentary' THEN 'C' ELSE CASE WHEN regexp_matches(text, " + literal(re2(CORPUS.extra["think_tank"])) + ") THEN 'C' ELSE 'U' END END"


@query(
    f"""WITH docs AS ({_TEXT}), classed AS (SELECT *, CASE {_CLASS} ELSE 'unknown_public' END AS source_class FROM docs),
    tiered AS (SELECT *, {_TIER_SQL} AS source_tier, {_CHANNEL_SQL} AS cw, regexp_matches(source, '[05]$') AS known FROM classed),
    w AS (SELECT *, CASE source_tier WHEN 'A' THEN 100 WHEN 'B' THEN 75 WHEN 'C' THEN 45 WHEN 'D' THEN 10 ELSE 35 END AS tw,
      CASE WHEN source_tier = 'D' THEN 0 WHEN source_tier IN ('C', 'U') OR NOT known OR cw < 40 THEN 1 ELSE 2 END AS lv FROM tiered)
    SELECT doc_id, source_class, source_tier, CAST(cw AS INT) AS channel_weight, ['low', 'medium', 'high'][lv + 1] AS credibility,
      CAST(least(tw * 50 + cw * 30 + CASE WHEN known THEN 2000 ELSE 500 END, [4500, 7000, 10000][lv + 1]) AS BIGINT) AS credibility_score FROM w"""
)
def q13_tier_credibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, tier, channel weight (unlisted channels are unknown), capped credibility in 1/10000."""
    rows = texts(spark, sf_dir)
    rows = credible(rows.withColumn("source_class", scoring.source_class(F.col("text"), CORPUS)))
    return rows.select("doc_id", "source_class", "source_tier", "channel_weight", "credibility", "credibility_score")


_ALL_NEXUS = CORPUS.nexus_direct + CORPUS.nexus_possible


@query(
    f"""WITH docs AS ({_TEXT}), n AS (SELECT doc_id, text, {_NEXUS} AS nexus, len(list_filter([{', '.join(f'regexp_matches(text, {literal(re2(r.pattern))})' for r in _ALL_NEXUS)}], lambda x: x)) AS k,
      regexp_extract(text, {literal(re2(CORPUS.nexus_direct[0].pattern))}) AS m FROM docs)
    SELECT doc_id, nexus, CAST(least(k, 8) AS INT) AS n_hits, CASE WHEN m <> '' THEN trim(regexp_replace(text[greatest(1, strpos(text, m) - 12):strpos(text, m) + length(m) + 11], '[\\s\\x{{00a0}}\\x{{3000}}\\x{{feff}}]+', ' ', 'g')) END AS evidence FROM n"""
)
def q14_nexus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nexus flag, hits, and 12 characters around the first direct cue."""
    rows = scoring.nexus(texts(spark, sf_dir), CORPUS)
    return rows.select("doc_id", "nexus", F.size("nexus_hits").alias("n_hits"), scoring.evidence(F.col("text"), CORPUS.nexus_direct[0].pattern).alias("evidence"))
