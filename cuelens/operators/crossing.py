"""Agreement between documents: shared terms, independent issuers, corroboration, related records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelens.functions.dialect import java
from cuelens.functions.scratch import kept
from cuelens.functions.text import char_grams, matches, most_specific
from cuelens.operators.scoring import CHANNEL_TIERS


def terms_in(text: Column, terms: tuple[str, ...]) -> Column:
    """The terms a text contains, without those nested in another one found."""
    return most_specific(F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t)), t) for t in terms])))


# What two passages can agree on to the letter.
ANCHORS = (r"\d+(\.\d+)?\s*(%|％|个百分点|亿元|万亿元|亿|万吨|万人)", r"20\d{2}\s*年(底|前)?", "《[^》]{2,40}》")


def anchors(text: Column) -> Column:
    """Distinct numbers with their units and years, without white space, and titles of a text."""
    plain = lambda m: F.regexp_replace(m, java(r"\s") + "+", "")
    numbers, years, titles = (matches(text, p) for p in ANCHORS)
    return F.array_distinct(F.concat(F.transform(F.concat(numbers, years), plain), titles))


def tier_spread(rows: DataFrame, run: str, order: str, tier: str = "channel") -> DataFrame:
    """(run, tiers, cross_tier) of runs with two known channel tiers or more: distinct ones in order of their first source."""
    first = rows.where(F.col(tier).isNotNull()).groupBy(run, tier).agg(F.min(order).alias("at"), F.count("*").alias("n"))
    spread = first.groupBy(run).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", F.col(tier).alias("t")))).alias("ts"))
    return spread.where("n >= 2").select(run, F.transform("ts", lambda x: x["t"]).alias("tiers"), (F.size("ts") > 1).alias("cross_tier"))


def weakest_tier(rows: DataFrame, run: str, order: str, tier: str = "channel") -> DataFrame:
    """(run, weakest): the channel tier of least weight among a run's sources; of equal ones that of the first source."""
    weight = F.create_map(*[F.lit(x) for k, w in CHANNEL_TIERS.items() for x in (k, w)])
    known = rows.where(F.col(tier).isNotNull())
    return known.groupBy(run).agg(F.min(F.struct(weight[F.col(tier)].alias("w"), F.col(order).alias("o"), F.col(tier).alias("t"))).alias("m")).select(run, F.col("m.t").alias("weakest"))


def limited_overlap(rows: DataFrame, run: str, text: str, terms: tuple[str, ...], source: str) -> DataFrame:
    """(run): runs of two sources or more in which a term occurs and none occurs in two of them."""
    found = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t)), t) for t in terms]))
    common = shared(rows.select(run, source, found.alias("terms")), run, "terms", source).select(run).distinct()
    seen = rows.groupBy(run).agg(F.count_distinct(source).alias("n"), F.bool_or(F.size(found) > 0).alias("any")).where("n >= 2 and any")
    return seen.select(run).join(common, run, "left_anti")


def topic_keys(desk: Column, themes: Column, kind: Column, subjects: Column, nuggets: Column, found: Column | None = None) -> Column:
    """``desk:``, ``hot:``, ``kind:``, ``subj:`` of subjects that sources share, ``nugget:`` and ``subj:`` of subjects ``found`` in the text, each once.

    Nuggets of sectors, places and instruments count, by their lower-case English, else their value.
    """
    named = F.filter(nuggets, lambda n: n["kind"].isin("named_sector_or_place", "named_instrument"))
    keyed = lambda prefix, values: F.transform(values, lambda v: F.concat(F.lit(prefix), v))
    one = lambda prefix, value: F.when(value.isNotNull(), F.array(F.concat(F.lit(prefix), value))).otherwise(F.array().cast("array<string>"))
    parts = [one("desk:", desk), keyed("hot:", themes), one("kind:", kind), keyed("subj:", subjects), keyed("nugget:", F.transform(named, lambda n: F.lower(F.coalesce(n["value_en"], n["value"]))))]
    return F.array_distinct(F.concat(*parts, *([keyed("subj:", found)] if found is not None else [])))


def shared(rows: DataFrame, run: str, terms: str, source: str, least: int = 2) -> DataFrame:
    """(run, term, n_sources) of terms that ``least`` distinct sources of a run hold.

    Sources are made distinct before they are counted, so a hot term is one row a source and task.
    """
    flat = rows.select(run, source, F.explode_outer(F.array_distinct(terms)).alias("term")).where("term is not null").distinct()
    return flat.groupBy(run, "term").agg(F.count("*").alias("n_sources")).where(F.col("n_sources") >= least)


def shared_terms(rows: DataFrame, run: str, terms: str, source: str) -> DataFrame:
    """(run, term) of terms that two sources of a run hold: the smallest and the largest source differ.

    Both are aggregated before the shuffle, so a term is one row a task, however many sources hold it.
    """
    # the outer form: an inner one would filter on the array and compute it again
    flat = rows.select(run, source, F.explode_outer(terms).alias("term")).where("term is not null")
    return flat.groupBy(run, "term").agg(F.min(source).alias("a"), F.max(source).alias("b")).where("a < b").select(run, "term")


#: Issuers that a set shares with others, up to which its partners are counted by subsets.
MOST_SHARED = 12


def independent_pair(rows: DataFrame, run: str, issuers: str, order: str) -> DataFrame:
    """(run, first, second): the first pair, by order, of sources with issuers that do not overlap.

    Sets are not paired. How many sets meet a set S is a sum over its subsets U that are not empty: the number of sets
    that hold all of U, counted for odd sizes and off for even ones. Those numbers are one aggregation over the subsets
    of all sets. The earliest set that fewer than all sets meet is the first of the pair, and its partner is the
    earliest set without its issuers. Issuers of one set alone can meet nothing and are left out. Sets with more than
    ``MOST_SHARED`` shared issuers, 4,096 subsets, are compared with the run's sets one by one.
    """
    sets = rows.where(F.size(issuers) > 0).groupBy(run, F.array_sort(F.array_distinct(issuers)).alias("set")).agg(F.min(order).alias("at"))
    flat = sets.select(run, "set", F.explode("set").alias("issuer"))
    common = flat.groupBy(run, "issuer").agg(F.count("*").alias("n")).where("n > 1").select(F.col(run).alias("_run"), F.col("issuer").alias("_issuer"))
    cores = flat.join(common, (F.col(run) == F.col("_run")) & (F.col("issuer") == F.col("_issuer"))).groupBy(run, "set").agg(F.array_sort(F.collect_list("issuer")).alias("core"))
    whole = sets.groupBy(run).agg(F.count("*").alias("n_sets"))
    few, many = cores.where(F.size("core") <= MOST_SHARED), cores.where(F.size("core") > MOST_SHARED)

    every = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("core")) - 1)
    picks = F.transform(every, lambda m: F.filter("core", lambda x, i: F.getbit(m, i) == 1))
    subsets = few.select(run, "set", F.explode(picks).alias("subset"))
    held = subsets.groupBy(run, "subset").agg(F.count("*").alias("n")).select(F.col(run).alias("_run"), F.col("subset").alias("_subset"), "n")
    sign = F.when(F.size("subset") % 2 == 1, 1).otherwise(-1)
    met = subsets.join(held, (F.col(run) == F.col("_run")) & (F.col("subset") == F.col("_subset"))).groupBy(run, "set").agg(F.sum(sign * F.col("n")).alias("met"))
    wide = many.select(F.col(run).alias("_run"), F.col("set").alias("_wide"))
    overlap = F.arrays_overlap("set", "_wide")
    by_wide = sets.join(wide, F.col(run) == F.col("_run")).where(overlap)
    met_wide = by_wide.groupBy(run, "set").agg(F.count("*").alias("met"))
    of_wide = by_wide.join(many.select(F.col(run).alias("r"), F.col("set").alias("s")), (F.col(run) == F.col("r")) & (F.col("set") == F.col("s")), "left_anti").groupBy(run, F.col("_wide").alias("set")).agg(F.count("*").alias("met"))
    all_met = met.unionByName(met_wide).unionByName(of_wide).groupBy(F.col(run).alias("_run"), F.col("set").alias("_set")).agg(F.sum("met").alias("met"))
    counted = sets.join(all_met, (F.col(run) == F.col("_run")) & (F.col("set") == F.col("_set")), "left").drop("_run")
    open_ = counted.join(whole.withColumnRenamed(run, "_run"), F.col(run) == F.col("_run")).where((F.col("n_sets") > 1) & (F.coalesce("met", F.lit(1)) < F.col("n_sets")))
    first = open_.groupBy(F.col(run).alias("_run")).agg(F.min(F.struct("at", "set")).alias("first"))
    partner = sets.join(first, F.col(run) == F.col("_run")).where(~F.arrays_overlap("set", F.col("first.set")))
    return partner.groupBy(run).agg(F.first("first.at").alias("first"), F.min("at").alias("second"))


def phrases(text: Column, formula: tuple[str, ...], n: int = 4, of: str = r"\p{L}") -> Column:
    """Character n-grams of a text without those of stock words."""
    stock = sorted({w[i : i + n] for w in formula for i in range(len(w) - n + 1)})
    return F.array_except(char_grams(text, n, of), F.array(*map(F.lit, stock)))


# What drives a corroboration.
DRIVERS = ("single_source_names_traceable_record", "cross_source_subject_match", "cross_source_detail_match", "independent_issuer_agreement", "three_plus_sources_same_subject", "cross_source_topic_overlap_only")
#: What a run lacks, by name.
GAPS = {
    "second_source": "a second source to compare with",
    "other_issuer": "a source of another issuer",
    "same_subject_wording": "a second source on the same named subject: these share wording alone",
    "same_subject": "a second source on the same named subject: these share nothing",
    "named_instrument": "a named document",
    "document_for_meeting": "the document that carries out what the meeting said",
    "checkable_detail": "numbers, dates or bodies that can be checked",
}
MOST_GAPS = 5


def corroborate(rows: DataFrame, run: str, source: str, order: str) -> DataFrame:
    """(run, n_sources, n_subjects, n_details, n_phrases, independent, corroboration 0-3, drivers, missing).

    ``rows``: run, source, order, subjects, issuers, details, phrases, traceable, has_instrument, has_meeting, thin; one row a distinct
    paste. drivers are those of ``DRIVERS``, missing up to ``MOST_GAPS`` of ``GAPS``; a run has an instrument or a meeting if one
    of its sources has, and is thin if all are.
    """
    grams = rows.select(run, order, "phrases")  # many and read once, so they are not written
    cues = ("traceable", "has_instrument", "has_meeting", "thin")
    rows = kept(rows.select(*dict.fromkeys([run, order, "subjects", "issuers", "details", *cues])), "sources")
    n = rows.groupBy(run).agg(
        F.count("*").alias("n_sources"), F.bool_or("traceable").alias("traceable"), F.bool_or("has_instrument").alias("has_instrument"), F.bool_or("has_meeting").alias("has_meeting"), F.bool_and("thin").alias("thin")
    )
    common = lambda terms, name: shared_terms(grams if terms == "phrases" else rows, run, terms, order).groupBy(run).agg(F.count("*").alias(name))
    pairs = independent_pair(rows, run, "issuers", order).select(run, F.lit(True).alias("independent"))
    joined = n.join(common("subjects", "n_subjects"), run, "left").join(common("details", "n_details"), run, "left").join(common("phrases", "n_phrases"), run, "left").join(pairs, run, "left")
    joined = joined.fillna(0, ["n_subjects", "n_details", "n_phrases"]).fillna(False, ["independent"])
    alone, agreed, wording = F.col("n_sources") < 2, F.col("n_subjects") > 0, F.col("n_phrases") >= 3
    apart = F.col("independent") | (F.col("n_sources") >= 3)
    score = F.when(alone, F.col("traceable").cast("int")).when(agreed, F.when(apart, 3).otherwise(2)).when(wording, 1).otherwise(0)
    both = ~alone & agreed
    named = [
        alone & F.col("traceable"), both, both & (F.col("n_details") > 0), both & F.col("independent"), both & ~F.col("independent") & (F.col("n_sources") >= 3), ~alone & ~agreed & wording,
    ]
    gap = F.when(alone, "second_source").when(agreed & ~apart, "other_issuer").when(agreed, None).when(wording, "same_subject_wording").otherwise("same_subject")
    gaps = [gap, F.when(~F.col("has_instrument"), "named_instrument"), F.when(F.col("has_meeting") & ~F.col("has_instrument"), "document_for_meeting"), F.when(F.col("thin"), "checkable_detail")]
    drivers = F.array_compact(F.array(*[F.when(test, name) for test, name in zip(named, DRIVERS, strict=True)]))
    return joined.select(
        run, "n_sources", "n_subjects", "n_details", "n_phrases", "independent", score.alias("corroboration"), drivers.alias("drivers"), F.slice(F.array_compact(F.array(*gaps)), 1, MOST_GAPS).alias("missing"),
    )
