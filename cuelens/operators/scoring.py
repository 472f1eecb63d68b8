"""Scorecard, kinds and importance, desks, themes, nexus, source class and tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelens.functions.dialect import java
from cuelens.functions.text import Marked, bind, first_match, seen
from cuelens.lexicon.rules import CARD_BONUS, Has, Pack, Rule

#: Thousandths of a rule's weight that each status counts.
STATUS = {"hit": 1000, "unclear": 400, "miss": 0}
# Tiers of source classes (weight in hundredths, highest confidence) and of channels (hundredths).
SOURCE_TIERS = {"A": (100, "high"), "B": (75, "high"), "C": (45, "medium"), "D": (10, "low"), "U": (35, "medium")}
CLASS_TIER = {"social_commentary": "D", "policy_instrument": "A", "official_or_wire": "B", "press_commentary": "C"}
CHANNEL_TIERS = {
    "central_party_organ": 100, "central_wire": 92, "central_broadcast": 85, "specialized_channel": 60, "ministry_official": 80,
    "cac_licensed_account": 50, "local_party_organ": 50, "commercial": 35, "unknown": 30,
}


def first_of(cases: list[tuple[Column, Column]], default: Column) -> Column:
    out = default
    for test, value in reversed(cases):
        out = F.when(test, value).otherwise(out)
    return out


def statuses(text: Column | Marked, pack: Pack) -> Column:
    """array<struct<name,category,weight,status>> of all signals, in order."""
    rows = []
    for s in pack.signals:
        status = first_of([(c.column(text), F.lit(name)) for name, c in s.cases], F.lit("unclear"))
        rows.append(F.struct(F.lit(s.name).alias("name"), F.lit(s.category).alias("category"), F.lit(s.weight).alias("weight"), status.alias("status")))
    return F.array(*rows)


def scorecard(docs: DataFrame, pack: Pack) -> DataFrame:
    """``docs`` with signals, the counts of each status, signal_sum (1/100000) and signal_band."""
    def worth(s: Column) -> Column:
        return s["weight"] * F.when(s["status"] == "hit", STATUS["hit"]).when(s["status"] == "unclear", STATUS["unclear"]).otherwise(STATUS["miss"])

    weights = sum(s.weight for s in pack.signals)
    rows = docs.withColumn("signals", statuses(seen(docs), pack))
    counts = {f"n_{k}": _count_status(k) for k in STATUS}
    rows = rows.withColumns(counts | {"signal_sum": F.aggregate("signals", F.lit(0), lambda a, s: a + worth(s))})
    return rows.withColumn("signal_band", F.when(F.col("signal_sum") >= 550 * weights, "high").when(F.col("signal_sum") >= 300 * weights, "medium").otherwise("low"))


def _count_status(status: str) -> Column:
    return F.size(F.filter("signals", lambda s: s["status"] == status))


def valves(card: DataFrame, categories: tuple[str, ...] = ("sequence", "implementing_detail", "press_placement")) -> DataFrame:
    """One column a category: observed if any of its rules hit, else absent if any missed, else unclear."""

    def valve(category: str) -> Column:
        has = lambda status: F.exists("signals", lambda s: (s["category"] == category) & (s["status"] == status))
        return F.when(has("hit"), "observed").when(has("miss"), "absent").otherwise("unclear")

    return card.withColumns({c: valve(c) for c in categories})


def hit_names(text: Column | Marked, rules: tuple[Rule, ...]) -> Column:
    """Names of the rules that match, in order."""
    return F.array_compact(F.array(*[F.when(Has(r.pattern).column(text), r.name) for r in rules]))


def triage(docs: DataFrame, pack: Pack) -> DataFrame:
    """``docs`` with kinds by weight, primary_kind, drivers, importance (thousandths) and grade.

    Uses signal_band, signal_sum and nexus_bump where ``docs`` has them.
    """
    text = seen(docs)
    hit = F.array_compact(F.array(*[F.when(Has(r.pattern).column(text), F.struct(F.lit(-r.weight).alias("w"), F.lit(i).alias("ord"), F.lit(r.name).alias("kind"))) for i, r in enumerate(pack.kinds)]))
    # a column of its own, used once: each rule is matched once
    rows = docs.withColumn("kinds", bind(F.transform(F.array_sort(hit), lambda k: k["kind"]), lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(F.lit("other_public_text")))))
    meeting, instrument = pack.extra.get("swapped_kinds", ("leadership_meeting", "implementing_instrument"))
    swap = F.array_contains("kinds", meeting) & F.array_contains("kinds", instrument) & pack.extra["instrument_over_meeting"].column(text)
    first = F.array(F.lit(instrument))
    rows = rows.withColumn("kinds", F.when(swap, F.concat(first, F.array_remove("kinds", instrument))).otherwise(F.col("kinds")))
    parts = []
    for name, milli, test in pack.drivers:
        if isinstance(test[0], str):
            holds = F.arrays_overlap("kinds", F.array(*map(F.lit, test)))
        else:
            holds = test[0].column(text)
            if test[1]:
                holds = holds & ~F.arrays_overlap("kinds", F.array(*map(F.lit, test[1])))
        parts.append((holds, name, milli))
    if "signal_band" in docs.columns:
        parts += [(F.col("signal_band") == "high", "signaling_band_high", 80), (F.col("signal_band") == "medium", "signaling_band_medium", 40)]
        parts.append((F.col("signal_sum") >= 50_000, "signaling_weighted_total>=0.5", 50))
    parts.append((F.length("text") < 80, "short_excerpt_penalty", -120))
    drivers = F.array_compact(F.array(*[F.when(h, n) for h, n, _ in parts]))
    total = F.lit(250)
    for holds, _, milli in parts:
        total = total + F.when(holds, milli).otherwise(0)
    if "nexus_bump" in docs.columns:
        total = total + F.col("nexus_bump")
    rows = rows.withColumns({"primary_kind": F.element_at("kinds", 1), "drivers": drivers, "importance": F.greatest(F.lit(0), F.least(F.lit(1000), total))})
    return rows.withColumn("grade", F.when(F.col("importance") >= 750, "P1").when(F.col("importance") >= 550, "P2").when(F.col("importance") >= 350, "P3").otherwise("P4"))


def desks(docs: DataFrame, pack: Pack) -> DataFrame:
    """``docs`` (with primary_kind) and themes, desk, secondary_desks, desk_score (thousandths)."""
    text = seen(docs)
    rows = docs.withColumn("themes", hit_names(text, pack.themes))
    where, extra = pack.extra["defense"]
    scored = []
    for i, d in enumerate(pack.desks):
        score = F.when(Has(d.pattern).column(text), 1000).otherwise(0)
        if d.kinds:
            score = score + F.when(F.col("primary_kind").isin(*d.kinds), 1200).otherwise(0)
        if d.name == where:
            score = score + F.when(extra.column(text), 800).otherwise(0)
        if i == 0:
            score = score + F.when(F.size("themes") > 0, 2000 + F.least(F.lit(1500), F.size("themes") * 400)).otherwise(0)
        scored.append(F.when(score > 0, F.struct((-score).alias("s"), F.lit(i).alias("ord"), F.lit(d.name).alias("desk"))))
    rows = rows.withColumn("_desks", F.array_sort(F.array_compact(F.array(*scored))))
    named = F.transform("_desks", lambda x: x["desk"])
    return rows.withColumns({"desk": F.coalesce(F.try_element_at(named, F.lit(1)), F.lit(pack.default_desk)), "secondary_desks": F.slice(named, 2, 2), "desk_score": F.coalesce(-F.try_element_at("_desks", F.lit(1))["s"], F.lit(0))}).drop("_desks")


def nexus(docs: DataFrame, pack: Pack) -> DataFrame:
    """``docs`` with nexus_hits (8 at most), nexus (direct, possible, none) and nexus_bump (thousandths)."""
    text = seen(docs)
    both = F.struct(hit_names(text, pack.nexus_direct).alias("direct"), hit_names(text, pack.nexus_possible).alias("possible"))
    flag = lambda b: F.when(F.size(b["direct"]) > 0, "direct").when(F.size(b["possible"]) > 0, "possible").otherwise("none")
    made = lambda b: F.struct(F.slice(F.concat(b["direct"], b["possible"]), 1, 8).alias("hits"), flag(b).alias("flag"))
    rows = docs.withColumn("_nexus", bind(both, made))
    rows = rows.withColumns({"nexus_hits": F.col("_nexus.hits"), "nexus": F.col("_nexus.flag")}).drop("_nexus")
    return rows.withColumn("nexus_bump", F.when(F.col("nexus") == "direct", 250).when(F.col("nexus") == "possible", 120).otherwise(0))


def source_class(text: Column | Marked, pack: Pack, forced: Column | None = None, label: Column | None = None) -> Column:
    """Forced class, else social by any social cue of the text or its label, else the first class whose pattern the text has."""
    hay = text if label is None else F.concat_ws("\n", text, label)
    cases = [(Has(r.pattern).column(hay), F.lit("social_commentary")) for r in pack.social] + [(Has(r.pattern).column(text), F.lit(r.name)) for r in pack.classes]
    found = first_of(cases, F.lit("unknown_public"))
    return found if forced is None else F.coalesce(forced, found)


def source_tier(text: Column, cls: Column, pack: Pack) -> Column:
    known = first_of([(cls == c, F.lit(t)) for c, t in CLASS_TIER.items()], F.lit(None))
    return F.coalesce(known, F.when(Has(pack.extra["think_tank"]).column(text), "C").otherwise("U"))


def tier_weight(tier: Column) -> Column:
    return first_of([(tier == k, F.lit(w)) for k, (w, _) in SOURCE_TIERS.items()], F.lit(None))


def channel_weight(channel: Column) -> Column:
    """Weight of a channel tier; an unlisted or missing one is unknown."""
    return first_of([(channel == k, F.lit(w)) for k, w in CHANNEL_TIERS.items()], F.lit(CHANNEL_TIERS["unknown"]))


def evidence(text: Column, pattern: str, reach: int = 12) -> Column:
    """The first match with ``reach`` characters on both sides, white space collapsed."""
    found = first_match(text, pattern)
    at = F.instr(text, found)
    start = F.greatest(F.lit(1), at - reach)
    cut = F.substring(text, start, at - start + F.length(found) + reach)
    return F.when(found != "", F.trim(F.regexp_replace(cut, java(r"\s") + "+", " ")))


def policy_overlay(docs: DataFrame, themes: tuple) -> DataFrame:
    """``docs`` with policy_hits, array<struct<theme,label,level,evidence,urls>> (six at most), and policy_level: named_instrument, topical or none."""
    text = F.col("text")
    hits = []
    for t in themes:
        level = F.when(Has(t.named).column(text), "named_instrument").otherwise("topical") if t.named else F.lit("topical")
        hit = F.struct(F.lit(t.name).alias("theme"), F.lit(t.label).alias("label"), level.alias("level"), evidence(text, t.pattern, 10).alias("evidence"), F.array(*[F.lit(u) for _, u in t.refs]).alias("urls"))
        hits.append(F.when(Has(t.pattern).column(text), hit))
    named = lambda h: F.when(F.exists(h, lambda x: x["level"] == "named_instrument"), "named_instrument").when(F.size(h) > 0, "topical").otherwise("none")
    rows = docs.withColumn("_policy", bind(F.array_compact(F.array(*hits)), lambda h: F.struct(F.slice(h, 1, 6).alias("hits"), named(h).alias("level"))))
    return rows.withColumns({"policy_hits": F.col("_policy.hits"), "policy_level": F.col("_policy.level")}).drop("_policy")


def item_role(text: Column | Marked, kind: Column, pack: Pack) -> Column:
    """A record's role on its desk's board, the first of these that holds: defence, diplomacy, society, instrument, meeting, sector."""
    has = lambda p: Has(p).column(text)
    words = pack.extra["roles"]
    return first_of(
        [
            ((kind == "defense_public") | has(words["defense_public"]), F.lit("defense_public")),
            ((kind == "foreign_affairs") | has(words["diplomatic"]), F.lit("diplomatic")),
            (kind.isin("social_governance", "ideology_party", "rural_revitalization") | has(words["social_or_ideology"]), F.lit("social_or_ideology")),
            (has(pack.instrument) | (kind == "implementing_instrument"), F.lit("implementing_instrument")),
            (has(pack.meeting) | kind.isin("leadership_meeting", "macro_policy", "dual_circulation"), F.lit("direction_meeting")),
            (kind.isin("finance_risk", "industrial_tech_policy", "economic_data"), F.lit("sector_or_risk")),
        ],
        F.lit("other"),
    )


def card_catalog(cards: DataFrame) -> list[dict]:
    """What ``match_cards`` takes, of ``read_cards``' rows: a catalog is written by hand and held by the driver."""
    return [{"id": r.name, "desks": list(r.desks), "match": list(r.match), "bonus": CARD_BONUS.get(r.type, 0)} for r in cards.collect()]


def match_cards(docs: DataFrame, cards: list[dict], most: int = 8) -> DataFrame:
    """(doc_id, card, score, k): each document's ``most`` best context cards that share a keyword with it.

    ``docs``: doc_id, text, desk. A card (id, desks, match, bonus in thousandths) scores 400 a keyword, 1000 on its own
    desk or 350 where it is for ``all``, and its bonus; ties go to the smaller id. In the row, without a join.
    """
    def scored(c: dict) -> Column:
        hits = sum((F.when(F.contains("text", F.lit(w)), 400).otherwise(0) for w in c["match"]), F.lit(0))
        own = F.when(F.col("desk").isin(*c["desks"]), 1000).otherwise(350 if "all" in c["desks"] else 0)
        return bind(hits, lambda h: F.when(h > 0, F.struct((-(h + own + c["bonus"])).alias("s"), F.lit(c["id"]).alias("card"))))

    rows = [scored(c) for c in sorted(cards, key=lambda c: c["id"])]
    best = F.slice(F.array_sort(F.array_compact(F.array(*rows))), 1, most)
    out = docs.select("doc_id", F.posexplode_outer(best).alias("at", "c")).where("at is not null")
    return out.select("doc_id", "c.card", (-F.col("c.s")).alias("score"), (F.col("at") + 1).alias("k"))
