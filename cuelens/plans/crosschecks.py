"""Queries that compare documents: terms, n-grams, issuers, corroboration, containment, gate, related records.

``lang`` with a document's first word is the run, every distinct paste a source of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelens.functions.dialect import literal
from cuelens.functions.text import matches, seen
from cuelens.lexicon import CORPUS
from cuelens.operators import containment, crossing, decisions, relating, scoring, substance
from cuelens.plans.registry import query, table
from cuelens.plans.screening import CARD_SQL, DESK_SQL, INTAKE_SQL, NUGGETS_SQL, desked, screen, screened, texts

SUBJECTS = ("thing", "ing", "tion", "leaux", "eaux", "schaft", "sch", "ción", "mente", "idiot", "clown", "the ")
ISSUERS = ("idiot", "clown", "***", "###", "Licensed", "@", " | ", "!!")
#: What sources can agree on to the letter.
DETAILS = r"\d{3,}"
FORMULA = ("that", "with", "from", "dans", "pour", "eine", "nicht", "para", "como")
_SUB = "[" + ", ".join(map(literal, SUBJECTS)) + "]"
_ISS = "[" + ", ".join(map(literal, ISSUERS)) + "]"
_STOCK = "[" + ", ".join(map(literal, sorted({w[i : i + 4] for w in FORMULA for i in range(len(w) - 3)}))) + "]"
_HITS = "list_filter({0}, lambda t: contains(text, t))"
_SPECIFIC = "list_filter({0}, lambda t: NOT list_bool_or(list_transform({0}, lambda o: o <> t AND contains(o, t))))"
_FOUND_SQL = f"""
  docs AS (SELECT doc_id, trim(text) AS text, lang, source FROM documents WHERE length(trim(text)) >= 20),
  pastes AS (SELECT min(doc_id) AS doc_id FROM docs GROUP BY regexp_replace(text, '\\s+', '', 'g')),
  hits AS (SELECT doc_id, text, lang, source, lang || ':' || regexp_extract(text, '^[^\\s]+') AS run, {_HITS.format(_SUB)} AS s0, {_HITS.format(_ISS)} AS i0 FROM docs SEMI JOIN pastes USING (doc_id)),
  found AS (SELECT doc_id, text, lang, source, run, coalesce({_SPECIFIC.format('s0')}, []) AS subjects, coalesce({_SPECIFIC.format('i0')}, []) AS issuers FROM hits),
  runs4 AS (SELECT doc_id, run, lang, source, unnest(regexp_extract_all(text, '\\pL{{4,}}')) AS r FROM found),
  grams AS (SELECT DISTINCT doc_id, run, lang, source, substr(r, i, 4) AS g FROM runs4, unnest(range(1, length(r) - 2)) AS t(i) WHERE NOT list_contains({_STOCK}, substr(r, i, 4)))"""


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pastes with run, subjects, issuers, traceable."""
    docs = texts(spark, sf_dir)
    first = substance.one_of_each_paste(docs).select("doc_id")
    rows = docs.join(first, "doc_id", "left_semi")
    run = F.concat("lang", F.lit(":"), F.regexp_extract("text", r"^[^\s]+", 0))
    return rows.withColumns({"run": run, "subjects": crossing.terms_in(F.col("text"), SUBJECTS), "issuers": crossing.terms_in(F.col("text"), ISSUERS)})


@query(f"WITH {_FOUND_SQL} SELECT lang, term, count(DISTINCT source) AS n_sources FROM (SELECT lang, source, unnest(subjects) AS term FROM found) GROUP BY ALL HAVING count(DISTINCT source) >= 2")
def q15_shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most specific subject terms that two sources of a language share."""
    return crossing.shared(found(spark, sf_dir), "lang", "subjects", "source")


@query(f"WITH {_FOUND_SQL} SELECT lang, count(*) AS n_grams, count(*) FILTER (n >= 2) AS n_shared FROM (SELECT lang, g, count(DISTINCT source) AS n FROM grams GROUP BY ALL) GROUP BY lang")
def q16_ngram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter 4-grams that are not stock, by language: all, and those of two sources or more."""
    rows = found(spark, sf_dir).select("lang", "source", F.explode_outer(crossing.phrases(F.col("text"), FORMULA)).alias("g")).where("g is not null").distinct()
    grams = rows.groupBy("lang", "g").agg(F.count("*").alias("n"))
    return grams.groupBy("lang").agg(F.count("*").alias("n_grams"), F.count_if(F.col("n") >= 2).alias("n_shared"))


_PAIR_SQL = "pairs AS (SELECT a.{0}, min((a.doc_id, b.doc_id)) AS p FROM found a JOIN found b ON a.{0} = b.{0} AND a.doc_id < b.doc_id WHERE len(a.issuers) > 0 AND len(b.issuers) > 0 AND NOT list_has_any(a.issuers, b.issuers) GROUP BY a.{0})"


@query(f"WITH {_FOUND_SQL}, {_PAIR_SQL.format('lang')} SELECT lang, p[1] AS first, p[2] AS second FROM pairs")
def q17_independent_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First pair of a language whose issuers do not overlap."""
    return crossing.independent_pair(found(spark, sf_dir), "lang", "issuers", "doc_id")


_CORR_SQL = f"""{_FOUND_SQL}, {_PAIR_SQL.format('run')},
  n AS (SELECT run, count(*) AS n_sources, bool_or({scoring.Has(CORPUS.instrument).sql('text')}) AS traceable, bool_or({scoring.Has(CORPUS.meeting).sql('text')}) AS meeting, bool_and(NOT regexp_matches(text, '\\d')) AS thin FROM found GROUP BY run),
  det AS (SELECT run, count(*) AS n_details FROM (SELECT run, d FROM (SELECT DISTINCT run, doc_id, unnest(regexp_extract_all(text, {literal(DETAILS)})) AS d FROM found) GROUP BY ALL HAVING count(*) >= 2) GROUP BY run),
  subj AS (SELECT run, count(*) AS n_subjects FROM (SELECT run, term FROM (SELECT run, doc_id, unnest(subjects) AS term FROM found) GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2) GROUP BY run),
  phr AS (SELECT run, count(*) AS n_phrases FROM (SELECT run, g FROM grams GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2) GROUP BY run),
  corr AS (
    SELECT n.run, n_sources, coalesce(n_subjects, 0) AS n_subjects, coalesce(n_phrases, 0) AS n_phrases, p IS NOT NULL AS independent,
      CASE WHEN n_sources < 2 THEN traceable::INT WHEN coalesce(n_subjects, 0) > 0 THEN CASE WHEN p IS NOT NULL OR n_sources >= 3 THEN 3 ELSE 2 END WHEN coalesce(n_phrases, 0) >= 3 THEN 1 ELSE 0 END
        AS corroboration, coalesce(n_details, 0) AS n_details, traceable, meeting, thin
    FROM n LEFT JOIN subj USING (run) LEFT JOIN det USING (run) LEFT JOIN phr USING (run) LEFT JOIN pairs USING (run))"""


def corroborated(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    instrument = scoring.Has(CORPUS.instrument).column(text)
    cues = {"traceable": instrument, "has_instrument": instrument, "has_meeting": scoring.Has(CORPUS.meeting).column(text), "thin": ~text.rlike(r"\d")}
    rows = found(spark, sf_dir).withColumns({"phrases": crossing.phrases(text, FORMULA), "details": F.array_distinct(matches(text, DETAILS)), **cues})
    return crossing.corroborate(rows, "run", "source", "doc_id")


@query(
    f"""WITH {_CORR_SQL}, g AS (SELECT *, n_sources < 2 AS alone, n_subjects > 0 AS agreed, n_phrases >= 3 AS wording FROM corr)
    SELECT run, n_sources, n_subjects, n_details, n_phrases, independent, CAST(corroboration AS INT) AS corroboration,
      array_to_string(list_filter([CASE WHEN alone AND traceable THEN 'single_source_names_traceable_record' END, CASE WHEN NOT alone AND agreed THEN 'cross_source_subject_match' END, CASE WHEN NOT alone AND agreed AND n_details > 0 THEN 'cross_source_detail_match' END,
        CASE WHEN NOT alone AND agreed AND independent THEN 'independent_issuer_agreement' WHEN NOT alone AND agreed AND n_sources >= 3 THEN 'three_plus_sources_same_subject' END, CASE WHEN NOT alone AND NOT agreed AND wording THEN 'cross_source_topic_overlap_only' END], lambda x: x IS NOT NULL), ',') AS drivers,
      array_to_string(list_filter([CASE WHEN alone THEN 'second_source' WHEN agreed THEN CASE WHEN NOT independent AND n_sources < 3 THEN 'other_issuer' END WHEN wording THEN 'same_subject_wording' ELSE 'same_subject' END,
        CASE WHEN NOT traceable THEN 'named_instrument' END, CASE WHEN meeting AND NOT traceable THEN 'document_for_meeting' END, CASE WHEN thin THEN 'checkable_detail' END], lambda x: x IS NOT NULL), ',') AS missing FROM g"""
)
def q18_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corroboration 0 to 3 of each run by subjects, issuers, details and wording that its sources share; what drives it, and what is missing. A text without a digit plays the thin one."""
    return corroborated(spark, sf_dir).withColumns({c: F.array_join(c, ",") for c in ("drivers", "missing")})


@query(
    f"""WITH {_CORR_SQL}, c AS (WITH {CARD_SQL} SELECT doc_id, signal_band FROM banded), s AS (WITH {NUGGETS_SQL} SELECT doc_id, band, milli FROM bands),
    j AS (SELECT found.doc_id, signal_band, band, milli, corroboration, n_sources, least(3, {scoring.Has(CORPUS.instrument).sql('text')}::INT + ({scoring.Has(CORPUS.instrument).sql('text')} AND {scoring.Has(CORPUS.meeting).sql('text')})::INT + (band = 'dense' OR regexp_matches(text, '\\d'))::INT) AS cues
      FROM found JOIN corr USING (run) JOIN c USING (doc_id) JOIN s USING (doc_id)),
    l AS (SELECT *, CASE WHEN n_sources < 2 THEN 0 ELSE least(CASE signal_band WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END, CASE WHEN band = 'thin' THEN 1 ELSE 2 END, CASE WHEN corroboration >= 2 THEN 2 WHEN corroboration = 0 THEN 0 ELSE 1 END) END AS lv FROM j)
    SELECT doc_id, ['low', 'medium', 'high'][lv + 1] AS confidence, CAST(least(floor(CASE signal_band WHEN 'high' THEN 700 WHEN 'medium' THEN 450 ELSE 200 END * 18 + milli * 132 / 10 + corroboration * 3600 + cues * 2000), [27000, 42000, 60000][lv + 1]) AS BIGINT) AS confidence_score FROM l"""
)
def q19_analysis_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence level under its caps, and score in 1/60000."""
    runs = corroborated(spark, sf_dir).select(F.col("run").alias("r"), "corroboration", F.col("n_sources").alias("distinct_sources"))
    text = F.col("text")
    instrument, meeting = scoring.Has(CORPUS.instrument).column(text), scoring.Has(CORPUS.meeting).column(text)
    rows = substance.cut(scoring.scorecard(found(spark, sf_dir), CORPUS), CORPUS).join(runs, F.col("run") == F.col("r"))
    detail = (F.col("substance_band") == "dense") | text.rlike(r"\d")
    rows = rows.withColumn("cue_count", instrument.cast("int") + (instrument & meeting).cast("int") + detail.cast("int"))
    return decisions.confidence(rows).select("doc_id", "confidence", "confidence_score")


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0")
def q20_quote_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages that a document holds word for word."""
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage"))
    return containment.contained(table(spark, sf_dir, "documents"), passages).select(F.col("passage_id").alias("item_id"), "doc_id")


@query(
    f"""WITH {INTAKE_SQL} SELECT doc_id, f.finding, f.severity FROM (
      SELECT doc_id, unnest([CASE WHEN source_class = 'social_commentary' THEN {{'finding': 'social_source', 'severity': 'soft'}} END, CASE WHEN band = 'thin' THEN {{'finding': 'thin_substance', 'severity': 'soft'}} END,
        CASE WHEN adopted AND n_support = 0 THEN {{'finding': 'adopted_without_support', 'severity': 'soft'}} END, CASE WHEN adopted AND source_class = 'social_commentary' THEN {{'finding': 'social_adopted', 'severity': 'hard'}} END,
        CASE WHEN n_nuggets = 0 THEN {{'finding': 'no_nuggets', 'severity': 'soft'}} END]) AS f FROM intake) WHERE f IS NOT NULL"""
)
def q21_gate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the claim gate on screened documents, long form."""
    adopted, social = F.col("adopted"), F.col("source_class") == "social_commentary"
    rules = [
        ("social_source", "soft", social),
        ("thin_substance", "soft", F.col("substance_band") == "thin"),
        ("adopted_without_support", "soft", adopted & (F.col("n_support") == 0)),
        ("social_adopted", "hard", adopted & social),
        ("no_nuggets", "soft", F.size("nuggets") == 0),
    ]
    return decisions.gate(screened(spark, sf_dir), rules)


_KEYS_SQL = f"""{DESK_SQL},
  named AS (WITH {NUGGETS_SQL} SELECT doc_id, list('nugget:' || lower(value) ORDER BY n) AS nk FROM nuggets WHERE kind IN ('named_sector_or_place', 'named_instrument') GROUP BY doc_id),
  keyed AS (SELECT doc_id AS id, nexus, ['desk:' || desk] AS d, list_filter([{', '.join(f"CASE WHEN {scoring.Has(r.pattern).sql('text')} THEN 'hot:{r.name}' END" for r in CORPUS.themes)}], lambda x: x IS NOT NULL) AS h,
    ['kind:' || primary_kind] AS k, coalesce(nk, []) AS n0, list_transform({_HITS.format(_SUB)}, lambda t: 'subj:' || t) AS s FROM desked LEFT JOIN named USING (doc_id)),
  once AS (SELECT *, list_filter(n0, lambda v, i: list_position(n0, v) = i) AS n FROM keyed),
  x AS (SELECT id, nexus, h || n || s AS con, d || k AS dk, len(h) + len(n) + len(s) + 2 AS size FROM once)"""


@query(
    f"""WITH {_KEYS_SQL},
    p AS (SELECT a.id, b.id AS other, list_filter(a.con, lambda v: list_contains(b.con, v)) AS common, a.dk, a.dk = b.dk AS soft, b.size, CASE b.nexus WHEN 'direct' THEN 3 WHEN 'possible' THEN 1 ELSE 0 END AS bonus FROM x a JOIN x b ON a.id <> b.id),
    s AS (SELECT *, (len(common) * 2 + bonus) * CASE WHEN len(common) > 0 THEN len(common)::DOUBLE / size ELSE 1.0 END + soft::INT AS score FROM p WHERE len(common) > 0 OR soft),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other DESC) AS k FROM s)
    SELECT id, other, round(score, 6) AS score, array_to_string(CASE WHEN len(common) > 0 THEN common[:6] ELSE dk END, ' | ') AS shared_keys, CAST(k AS INT) AS k FROM r WHERE k <= 6"""
)
def q27_related_top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six best related documents of each, newest (largest id) first among equals, and the keys they share."""
    subjects = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(t)), t) for t in SUBJECTS]))
    keys = crossing.topic_keys(F.col("desk"), F.col("themes"), F.col("primary_kind"), F.array().cast("array<string>"), F.col("nuggets"), subjects)
    rows = substance.cut(desked(spark, sf_dir), CORPUS).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("created"), keys.alias("keys"), "nexus")
    return relating.related(rows).withColumns({"score": F.round("score", 6), "shared_keys": F.array_join("shared_keys", " | ")})


_HAS = lambda pattern: scoring.Has(pattern).sql("text")
_ROLES = CORPUS.extra["roles"]
_ROLE_SQL = f"""CASE WHEN primary_kind = 'defense_public' OR {_HAS(_ROLES['defense_public'])} THEN 'defense_public' WHEN primary_kind = 'foreign_affairs' OR {_HAS(_ROLES['diplomatic'])} THEN 'diplomatic'
      WHEN {_HAS(_ROLES['social_or_ideology'])} THEN 'social_or_ideology' WHEN {_HAS(CORPUS.instrument)} THEN 'implementing_instrument' WHEN {_HAS(CORPUS.meeting)} THEN 'direction_meeting' ELSE 'other' END"""


@query(
    f"""WITH {DESK_SQL}, t AS (SELECT desk, importance, {_ROLE_SQL} AS role FROM desked)
    SELECT desk, count(*) AS n_items, CAST(max(importance) AS INT) AS max_score, round(avg(importance), 2) AS avg_score, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles,
      bool_or(role = 'direction_meeting') AND bool_or(role = 'implementing_instrument') AS pairable FROM t GROUP BY desk"""
)
def q28_section_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By desk: items, scores, the roles of its items, and whether a direction and an instrument can be paired."""
    from cuelens.operators.history import board

    rows = desked(spark, sf_dir)
    rows = rows.select("desk", F.col("importance").alias("score"), scoring.item_role(seen(rows), F.col("primary_kind"), CORPUS).alias("role"))
    return board(rows.withColumns({"direction": F.col("role") == "direction_meeting", "instrument": F.col("role") == "implementing_instrument"}), "desk")


@query(
    f"""WITH i AS (WITH {INTAKE_SQL} SELECT doc_id, intake, adopted, band, gray, source_class FROM intake), c AS (WITH {_CORR_SQL} SELECT run, n_sources, corroboration FROM corr),
    j AS (SELECT i.*, n_sources, corroboration FROM i JOIN documents USING (doc_id) JOIN c ON run = lang || ':' || regexp_extract(trim(text), '^[^\\s]+')),
    v AS (SELECT *, CASE WHEN intake IN ('defer', 'social_downweight') OR NOT adopted OR (band = 'thin' AND corroboration <= 1) THEN 'low' WHEN band = 'dense' AND corroboration >= 2 THEN 'high' ELSE 'medium' END AS info_value,
      list_filter([CASE WHEN n_sources < 2 THEN 'second_excerpt' END, CASE WHEN band = 'thin' OR corroboration < 2 THEN 'implementing_notice' END, CASE WHEN corroboration < 1 THEN 'second_source' END], lambda x: x IS NOT NULL) AS steps FROM j)
    SELECT doc_id, info_value, array_to_string(CASE WHEN intake = 'defer' THEN ['wait_for_notice', 'rerun_on_detail'] WHEN intake = 'social_downweight' THEN ['official_excerpt'] WHEN NOT adopted THEN ['excerpt_with_detail', 'more_than_direction']
        WHEN len(steps) = 0 THEN ['verify'] ELSE steps[1:CASE WHEN info_value = 'low' THEN 4 ELSE 3 END] END, ',') AS next_steps,
      array_to_string(list_filter([CASE WHEN source_class = 'unknown_public' THEN 'source_class:open' END, CASE WHEN gray AND NOT adopted THEN 'intake_gray:open' END, CASE WHEN adopted THEN 'domain_profile:open' END], lambda x: x IS NOT NULL), ',') AS review FROM v"""
)
def q39_review_and_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a record is worth, what to do next, and the guessed decisions that a human should confirm; no text of the corpus has a domain of its own, and dates are taken as given."""
    runs = corroborated(spark, sf_dir).select(F.col("run").alias("r"), "corroboration", F.col("n_sources").alias("distinct_sources"))
    run = F.concat("lang", F.lit(":"), F.regexp_extract("text", r"^[^\s]+", 0))
    rows = screened(spark, sf_dir).withColumn("gray_open", decisions.gray_zone(CORPUS) & ~F.col("adopted")).join(runs, run == F.col("r"))
    none = F.lit(None).cast("string")
    undated = F.struct(F.lit(None).cast("date").alias("date"), F.lit("none").alias("method"), F.lit("none").alias("precision"))
    rows = decisions.brief_quality(rows.withColumn("as_of", undated), operator_dated=F.lit(True)).withColumn("missing_cues", F.lit(None).cast("array<string>"))
    guesses = {
        "class_ambiguous": F.col("source_class") == "unknown_public", "forced_class": none, "auto_intake": F.col("intake"), "intake_overridden": F.lit(False),
        "profile": F.lit("general_policy"), "desk_guessed": F.lit(False), "forced_profile": none,
    }
    rows = decisions.review_points(decisions.next_steps(rows).withColumns(guesses))
    points = F.transform("review", lambda p: F.concat(p["id"], F.lit(":"), p["status"]))
    return rows.select("doc_id", "info_value", F.array_join("next_steps", ",").alias("next_steps"), F.array_join(points, ",").alias("review"))


@query(
    f"""WITH {INTAKE_SQL}, p AS (SELECT CAST(quality AS INT) AS gold, (intake IN ('admit', 'defer'))::INT AS pred, lang FROM intake JOIN labels USING (doc_id))
    SELECT lang AS zone, count(*) AS n, count(*) FILTER (gold = pred) AS n_right, count(*) FILTER (pred = 1 AND gold = 0) AS false_admit, count(*) FILTER (pred = 0 AND gold = 1) AS false_reject FROM p GROUP BY lang"""
)
def q36_gold_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intake against labels by zone: right, falsely admitted, falsely rejected. Documents without a label are left out before they are screened."""
    gold = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("gold"))
    pred = F.col("intake").isin("admit", "defer").cast("int")
    rows = screen(texts(spark, sf_dir).join(gold, "doc_id")).withColumn("pred", pred)
    return rows.groupBy(F.col("lang").alias("zone")).agg(
        F.count("*").alias("n"), F.count_if(F.col("gold") == F.col("pred")).alias("n_right"),
        F.count_if((F.col("pred") == 1) & (F.col("gold") == 0)).alias("false_admit"), F.count_if((F.col("pred") == 0) & (F.col("gold") == 1)).alias("false_reject"),
    )

