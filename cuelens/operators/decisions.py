"""Adoption, intake, credibility, confidence, quality, gate and review: decisions on scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelens.functions.dialect import java
from cuelens.functions.text import Marked, seen
from cuelens.lexicon.rules import Has, Pack
from cuelens.operators.scoring import SOURCE_TIERS, first_of

LEVELS = ("low", "medium", "high")


def rank(level: Column) -> Column:
    return F.when(level == "high", 2).when(level == "medium", 1).otherwise(0)


def level(n: Column) -> Column:
    return F.when(n >= 2, "high").when(n >= 1, "medium").otherwise("low")


def adoption(docs: DataFrame, pack: Pack) -> DataFrame:
    """``docs`` (with nuggets) and n_strong, n_support, adopted, hard (10 at most).

    A nugget is strong if its evidence, the clause it stands in, has what its kind needs, or its English value has.
    """

    def strong(n: Column) -> Column:
        def test(kind: str, pattern: str) -> Column:
            if not pattern:
                return F.lit(True)
            told = n["evidence"].rlike(java(pattern))
            english = pack.actionable_en.get(kind)
            return told | F.coalesce(n["value_en"].rlike(java(english)), F.lit(False)) if english else told

        return first_of([(n["kind"] == k, test(k, p)) for k, p in pack.actionable.items()], F.lit(False))

    support = F.concat(*[_two(kind) for kind in pack.support])
    rows = docs.withColumns({"_strong": F.filter("nuggets", strong), "_support": support})
    n, s = F.size("_strong"), F.size("_support")
    adopted = (n >= 1) & (n + F.when(s > 0, 1).otherwise(0) >= 2)
    hard = F.when(adopted, F.slice(F.concat("_strong", "_support"), 1, 10)).otherwise(F.slice(F.col("_strong"), 1, 0))
    return rows.withColumns({"n_strong": n, "n_support": s, "adopted": adopted, "hard": hard}).drop("_strong", "_support")


def _two(kind: str) -> Column:
    return F.slice(F.filter("nuggets", lambda n: n["kind"] == kind), 1, 2)


def has_kind(kind: str) -> Column:
    return F.exists("nuggets", lambda n: n["kind"] == kind)


def gray_zone(pack: Pack, text: Column | Marked | None = None) -> Column:
    """A body and a sector, a ban and a sector, a watched theme in a thin text, or a time without a strong cue."""
    sector = has_kind("named_sector_or_place")
    watched = (F.col("substance_band") == "thin") & Has(pack.gray).column(F.col("text") if text is None else text)
    return (has_kind("responsible_body") & sector) | (has_kind("constraint_or_ban") & sector) | watched | (has_kind("timeline") & (F.col("n_strong") == 0))


def intake(docs: DataFrame, pack: Pack, override: str | None = None) -> DataFrame:
    """``docs`` (adopted, source_class, substance_band, n_strong) and intake.

    Social texts are down-weighted, adopted ones admitted; another waits if it is in the gray zone. ``override`` names a
    column that decides there.
    """
    gray = gray_zone(pack, seen(docs))
    thin = F.when(gray, "defer").otherwise("reject_thin")
    if override:
        thin = F.coalesce(F.when(gray, F.col(override)), thin)
    return docs.withColumn("intake", F.when(F.col("source_class") == "social_commentary", "social_downweight").when(F.col("adopted"), "admit").otherwise(thin))


def credibility(docs: DataFrame) -> DataFrame:
    """``docs`` (source_class, source_tier, tier_weight, channel_weight in hundredths, provenance) and credibility, credibility_score."""
    top = first_of([(F.col("source_tier") == t, F.lit(LEVELS.index(m))) for t, (_, m) in SOURCE_TIERS.items()], F.lit(1))
    cap = F.when(F.col("source_class") == "social_commentary", 0).otherwise(top)
    cap = F.when((F.col("provenance") == "weak") | (F.col("channel_weight") < 40), F.least(cap, F.lit(1))).otherwise(cap)
    # in 1/10000: 0.5 of the tier, 0.3 of the channel, 0.2 or 0.05 for provenance
    blend = F.col("tier_weight") * 50 + F.col("channel_weight") * 30 + F.when(F.col("provenance") == "adequate", 2000).otherwise(500)
    rows = docs.withColumn("credibility", level(cap))
    ceiling = F.when(F.col("credibility") == "high", 10000).when(F.col("credibility") == "medium", 7000).otherwise(4500)
    return rows.withColumn("credibility_score", F.least(blend, ceiling).cast("long"))


def confidence(docs: DataFrame) -> DataFrame:
    """``docs`` (signal_band, substance_band, substance_milli, corroboration, distinct_sources, cue_count) and confidence, confidence_score (1/60000)."""
    n = rank(F.col("signal_band"))
    n = F.when(F.col("substance_band") == "thin", F.least(n, F.lit(1))).otherwise(n)
    crossed = F.col("corroboration") >= 2
    n = F.when(F.col("distinct_sources") < 2, 0).when(~crossed, F.least(n, F.when(F.col("corroboration") == 0, 0).otherwise(1))).otherwise(n)
    rows = docs.withColumn("confidence", level(n))
    base = F.when(F.col("signal_band") == "high", 700).when(F.col("signal_band") == "medium", 450).otherwise(200)
    # in 1/60000: 0.3 of the band's base, 0.22 of substance, 0.18 of corroboration / 3, 0.1 of cues / 3
    blend = base * 18 + (F.col("substance_milli") * 132 / 10) + F.col("corroboration") * 3600 + F.col("cue_count") * 2000
    ceiling = F.when(F.col("confidence") == "high", 60000).when(F.col("confidence") == "medium", 42000).otherwise(27000)
    return rows.withColumn("confidence_score", F.least(F.floor(blend).cast("long"), ceiling.cast("long")))


def freshness(age: Column, precision: Column) -> Column:
    """Band of an age in days: unknown without one, weak for a relative date."""
    dated = F.when(age <= 7, "fresh").when(age <= 30, "recent").when(age <= 90, "aging").otherwise("stale")
    return F.when(age.isNull() | (precision == "none"), "unknown").when(precision == "relative", "weak").otherwise(dated)


def clamp_likelihood(likelihood: Column, band: Column) -> Column:
    """A likelihood level no higher than freshness allows: unknown low; weak, aging or stale medium."""
    return level(F.least(rank(likelihood), likelihood_cap(band)))


def likelihood_cap(band: Column) -> Column:
    return F.when(band == "unknown", 0).when(band.isin("weak", "aging", "stale"), 1).otherwise(2)


def clamp_scenarios(scenarios: Column, band: Column) -> Column:
    """Scenarios by their own likelihood, falling, ties in their order; then each no likelier than freshness allows.

    An unknown likelihood counts as low. The order still tells what the clamp hides.
    """
    keyed = F.transform(scenarios, lambda s, i: F.struct((-rank(F.lower(s["likelihood"]))).alias("r"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"].withField("likelihood", level(F.least(-x["r"], likelihood_cap(band)))))


def brief_quality(docs: DataFrame, operator_dated: Column | None = None) -> DataFrame:
    """``docs`` (adopted, distinct_sources, as_of struct<date,method,precision>) and quality (complete, partial, rejected), quality_missing.

    Complete is adopted, with two distinct sources, and dated: by the operator, by a provided date, or by a date of the text that is not relative.
    """
    dated = (F.col("as_of.method") == "provided") | (~F.col("as_of.precision").isin("none", "relative") & F.col("as_of.date").isNotNull())
    if operator_dated is not None:
        dated = F.coalesce(operator_dated, F.lit(False)) | dated
    dated = F.coalesce(dated, F.lit(False))
    gaps = F.array_compact(F.array(F.when(F.col("distinct_sources") < 2, "second_public_source"), F.when(~dated, "source_as_of")))
    rows = docs.withColumn("quality_missing", F.when(F.col("adopted"), gaps).otherwise(F.array(F.lit("actionable_hard_detail"))))
    return rows.withColumn("quality", F.when(~F.col("adopted"), "rejected").when(F.size("quality_missing") > 0, "partial").otherwise("complete"))


def info_value(intake: Column, adopted: Column, band: Column, corroboration: Column) -> Column:
    """What a record is worth: low where it waits, is social or was not adopted; high if dense and cross-checked; low if thin and not."""
    low = intake.isin("defer", "social_downweight") | ~adopted | ((band == "thin") & (corroboration <= 1))
    return F.when(low, "low").when((band == "dense") & (corroboration >= 2), "high").otherwise("medium")


#: What a reader can do next, by the name of the step.
NEXT_STEPS = {
    "wait_for_notice": "Leave it waiting until a notice that carries it out is public",
    "rerun_on_detail": "Run it again once a notice, an amount or a dated document exists",
    "official_excerpt": "Find what an office or agency published on it; this is comment",
    "excerpt_with_detail": "Look for a passage with a number, a date or a named document",
    "more_than_direction": "Meeting language and direction are not enough for a brief",
    "second_excerpt": "Bring a second published passage on the subject",
    "dateline": "State when the source was published",
    "implementing_notice": "Bring the notice that carries it out, and run both together",
    "second_source": "Bring a source that does not repeat the first",
    "verify": "Compare numbers, dates and bodies with a public page",
}


def next_steps(docs: DataFrame) -> DataFrame:
    """``docs`` (intake, adopted, substance_band, corroboration, quality_missing, missing_cues) and info_value, next_steps: names of ``NEXT_STEPS``, and up to two cues that are missing.

    A record that waits, is social or was not adopted gets the steps of that; others up to three, four where they are worth little.
    """
    value = info_value(F.col("intake"), F.col("adopted"), F.col("substance_band"), F.col("corroboration"))
    lacks = lambda what: F.array_contains("quality_missing", what)
    open_ = F.array_compact(F.array(
        F.when(lacks("second_public_source"), "second_excerpt"), F.when(lacks("source_as_of"), "dateline"),
        F.when((F.col("substance_band") == "thin") | (F.col("corroboration") < 2), "implementing_notice"), F.when(F.col("corroboration") < 1, "second_source"),
    ))
    found = F.concat(open_, F.slice(F.coalesce("missing_cues", F.array().cast("array<string>")), 1, 2))
    some = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("verify")))
    names = lambda *steps: F.array(*map(F.lit, steps))
    steps = (
        F.when(F.col("intake") == "defer", names("wait_for_notice", "rerun_on_detail"))
        .when(F.col("intake") == "social_downweight", names("official_excerpt"))
        .when(~F.col("adopted"), names("excerpt_with_detail", "more_than_direction"))
        .otherwise(F.slice(some, F.lit(1), F.when(F.col("info_value") == "low", 4).otherwise(3)))
    )
    return docs.withColumn("info_value", value).withColumn("next_steps", steps)


def review_points(docs: DataFrame) -> DataFrame:
    """``docs`` and review, array<struct<id,system_pick,status,resolved>>: the three decisions that were guessed.

    ``docs``: class_ambiguous, forced_class, gray_open, auto_intake, intake, intake_overridden, adopted, profile, desk_guessed, forced_profile.
    """

    def point(name: str, pick: Column, done: Column, value: Column) -> Column:
        return F.struct(F.lit(name).alias("id"), pick.alias("system_pick"), F.when(done, "resolved").otherwise("open").alias("status"), F.when(done, value).alias("resolved"))

    guessed = F.col("adopted") & ((F.col("profile") == "general_policy") | F.col("desk_guessed"))
    points = [
        F.when(F.col("class_ambiguous"), point("source_class", F.lit("unknown_public"), F.col("forced_class").isNotNull(), F.col("forced_class"))),
        F.when(F.col("gray_open"), point("intake_gray", F.coalesce("auto_intake", F.lit("reject_thin")), F.col("intake_overridden"), F.col("intake"))),
        F.when(guessed, point("domain_profile", F.coalesce("profile", F.lit("general_policy")), F.col("forced_profile").isNotNull(), F.col("forced_profile"))),
    ]
    return docs.withColumn("review", F.array_compact(F.array(*points)))


def gate(docs: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """Long findings of ``rules`` (id, severity, column that holds for an offence): doc_id, finding, severity.

    A null test is no offence. A record passes if none of its findings is hard (``passed``).
    """
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(i).alias("finding"), F.lit(s).alias("severity"))) for i, s, test in rules]))
    return docs.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.finding", "f.severity")


def passed(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """``docs`` and gate_passed: no hard finding. Findings are counted by document before they meet the documents."""
    hard = findings.where("severity = 'hard'").groupBy("doc_id").agg(F.count("*").alias("_hard")).withColumnRenamed("doc_id", "_hard_id")
    return docs.join(hard, F.col("doc_id") == F.col("_hard_id"), "left").withColumn("gate_passed", F.col("_hard").isNull()).drop("_hard", "_hard_id")
