"""Substance: stock-phrase share, capped detail nuggets, and the band they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelens.functions.gloss import looked_up, render
from cuelens.functions.text import Marked, around, bind, first_match, first_spans, held, plain, seen
from cuelens.lexicon.rules import Pack
from cuelens.operators.scoring import CHANNEL_TIERS

PER_KIND, IN_ALL = 4, 16
NUGGET = "struct<kind:string,value:string,evidence:string,value_en:string,start:int>"


def normalise(docs: DataFrame, least: int = 20) -> DataFrame:
    """Texts trimmed, those of fewer than ``least`` characters dropped."""
    text = F.trim("text")
    return docs.where(F.length(text) >= least).withColumn("text", text)


def sources(requests: DataFrame, least: int = 20) -> DataFrame:
    """(run, src, label, text, url, channel) of requests, one row a source that has ``least`` characters.

    ``requests``: run, sources array<struct<label,text,url,channelTier>>, sourceText, sourceLabel, sourceUrl,
    sourceChannelTier. The list counts if it is not empty, else the single text. Missing labels are ``source`` in a
    list and ``paste-1`` alone; a channel tier that is none of the known is null.
    """
    many = F.transform("sources", lambda s: F.struct(F.trim(F.coalesce(s["label"], F.lit("source"))).alias("label"), F.trim(F.coalesce(s["text"], F.lit(""))).alias("text"), F.nullif(F.trim(s["url"]), F.lit("")).alias("url"), s["channelTier"].alias("channel")))
    one = F.array(F.struct(F.coalesce(F.nullif("sourceLabel", F.lit("")), F.lit("paste-1")).alias("label"), F.trim(F.coalesce("sourceText", F.lit(""))).alias("text"), F.col("sourceUrl").alias("url"), F.col("sourceChannelTier").alias("channel")))
    chosen = F.filter(F.when(F.size("sources") > 0, many).otherwise(one), lambda s: F.length(s["text"]) >= least)
    rows = requests.select("run", F.posexplode(chosen).alias("src", "s")).select("run", "src", "s.*")
    return rows.withColumn("channel", F.when(F.col("channel").isin(*CHANNEL_TIERS), F.col("channel")))


def within_limit(requests: DataFrame, most: int = 24_000) -> DataFrame:
    """Requests whose texts, in both shapes together, have ``most`` characters at most."""
    listed = F.aggregate(F.coalesce("sources", F.array().cast(requests.schema["sources"].dataType)), F.lit(0), lambda a, s: a + F.coalesce(F.length(s["text"]), F.lit(0)))
    return requests.where(F.coalesce(F.length("sourceText"), F.lit(0)) + listed <= most)


def one_of_each_paste(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """Texts equal but for white space once, at their first place; by a hash of the text and not the text itself."""
    key = F.sha2(F.regexp_replace("text", r"\s+", ""), 256)
    return docs.groupBy(key.alias("paste_key")).agg(F.min(order).alias(order), F.count("*").alias("copies"))


def _first_ones(text: Column | Marked, pattern: str, kind: str) -> Column:
    """The first ``PER_KIND`` distinct matches, each at its first place."""
    return F.transform(first_spans(text, pattern, PER_KIND), lambda x: F.struct(F.lit(kind).alias("kind"), x["value"].alias("value"), x["start"].alias("start")))


def nuggets(text: Column | Marked, pack: Pack, facts: Column | None = None) -> Column:
    """array<NUGGET>: distinct matches by kind, ``PER_KIND`` of each, ``IN_ALL`` in catalog order, each with its evidence.

    The evidence is the clause around the match. Where ``facts`` are given and one of a kind that explains the nugget
    overlaps it, or else is the nearest that its clause holds, the evidence is that fact's and so is the English value; without
    one the value is what the pack's glossary makes of it, or else what its kind is called.
    """
    first = F.slice(F.concat(*[_first_ones(text, r.pattern, r.name) for r in pack.detectors]), 1, IN_ALL)

    def told(n: Column) -> Column:
        clause = around(plain(text), n["start"], n["value"])
        if facts is None or not pack.fact_kinds:
            return F.struct(n["kind"].alias("kind"), n["value"].alias("value"), clause.alias("evidence"), F.lit(None).cast("string").alias("value_en"), n["start"].alias("start"))
        wanted = looked_up({k: f" {' '.join(v)} " for k, v in pack.fact_kinds.items()}, n["kind"])
        fit = F.filter(facts, lambda f: F.contains(wanted, F.concat(F.lit(" "), f["kind"], F.lit(" "))))
        end = n["start"] + F.length(n["value"])
        over = F.try_element_at(F.filter(fit, lambda f: (n["start"] < f["end"]) & (end > f["start"])), F.lit(1))
        near = F.array_sort(F.transform(F.filter(fit, lambda f: F.contains(clause, f["value"])), lambda f: F.struct(F.abs(f["start"] - n["start"]).alias("far"), f["start"].alias("at"), f.alias("f"))))
        found = F.struct(F.coalesce(over, F.try_element_at(near, F.lit(1))["f"]).alias("fact"))
        with_fact = lambda x: F.struct(n["kind"].alias("kind"), n["value"].alias("value"), F.coalesce(x["fact"]["quote"], clause).alias("evidence"), F.coalesce(_value_en(n["kind"], x["fact"]), _glossed(n, pack)).alias("value_en"), n["start"].alias("start"))
        return bind(found, with_fact)

    return F.transform(first, told).cast(f"array<{NUGGET}>")


def _glossed(n: Column, pack: Pack) -> Column:
    """English of a nugget that no fact explains."""
    called = looked_up(pack.cue_phrases, n["kind"]) if pack.cue_phrases else F.lit(None).cast("string")
    return F.coalesce(F.nullif(render(n["value"], pack.glossary)["en"], F.lit("")), called) if pack.glossary else called


def _value_en(kind: Column, fact: Column) -> Column:
    """English value of a nugget by the fact behind it: a number shows the amount, a funding line its vehicle and amount."""
    money = fact["kind"] == "money"
    vehicle = F.when(fact["amount_en"].isNotNull(), F.concat(fact["vehicle"], F.lit(" ("), fact["amount_en"], F.lit(")"))).otherwise(fact["vehicle"])
    return F.when((kind == "numeric_target") & money & fact["amount_en"].isNotNull(), fact["amount_en"]).when((kind == "resource_or_funding") & money & fact["vehicle"].isNotNull(), vehicle).otherwise(fact["value_en"])


def empty_calories(text: Column, found: Column, pack: Pack) -> Column:
    """Names of the warnings a text earns: wording that promises and nothing that can be checked; ``pack.extra`` holds the wording."""
    words = pack.extra.get("calories", {})
    has = lambda *kinds: F.exists(found, lambda n: n["kind"].isin(*kinds))
    cases = []
    if "posture" in words:
        cases.append(F.when(words["posture"].column(text) & ~has("named_instrument"), "verbs_without_instrument"))
        cases.append(F.when(words["slogan"].column(text) & ~has("numeric_target", "timeline"), "slogans_without_numbers"))
        cases.append(F.when(words["propaganda"].column(text) & (F.size(found) < 2), "mobilisation_without_policy"))
    return F.array_compact(F.array(*cases, F.when(F.size(found) == 0, "no_detail")))


def boilerplate(text: Column | Marked, pack: Pack) -> Column:
    """Characters that the first match of each stock phrase covers, at most the text's."""
    covered = F.lit(0)
    for r in pack.boilerplate:
        covered = covered + F.length(first_match(text, r.pattern))
    return F.least(covered, F.length(plain(text)))


def score_milli(found: Column) -> Column:
    """Thousandths: 120 a kind and 40 a nugget, 1000 at most."""
    kinds = F.size(F.array_distinct(F.transform(found, lambda n: n["kind"])))
    return F.least(F.lit(1000), kinds * 120 + F.size(found) * 40)


def band(milli: Column) -> Column:
    return F.when(milli >= 450, "dense").when(milli >= 200, "mixed").otherwise("thin")


def cut(docs: DataFrame, pack: Pack) -> DataFrame:
    """``docs`` with nuggets, boilerplate_ratio, substance_milli and substance_band; its ``facts``, if it has them, explain nuggets."""
    with_nuggets = held(docs.drop("nuggets"), "nuggets", nuggets(seen(docs), pack, F.col("facts") if "facts" in docs.columns else None))
    ratio = F.when(F.length("text") > 0, F.round(boilerplate(seen(docs), pack) / F.length("text"), 3)).otherwise(0.0)
    scored = with_nuggets.withColumns({"boilerplate_ratio": ratio, "substance_milli": score_milli(F.col("nuggets"))})
    return scored.withColumn("substance_band", band(F.col("substance_milli")))
