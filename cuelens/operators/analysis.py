"""Content analysis of screened rows with facts: the domain profile, what follows, scenarios, what to watch and to ask."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelens.functions.gloss import capital, without_article
from cuelens.functions.text import bind
from cuelens.lexicon.profiles import GENERIC, PROFILES, Piece, Profile, Scenario
from cuelens.lexicon.rules import Has
from cuelens.operators import facts as f
from cuelens.operators.scoring import first_of

ALL = (*PROFILES, GENERIC)
_SCENARIO = "struct<label:string,likelihood:string,horizon:string,basis:string,trigger:string,alternative:string,falsifier:string>"
ALTERNATIVE = "Words alone, with attention going to other matters (hypothesis)."
#: Subjects whose finances are under strain.
STRAINED = "(?i)debt|real estate|housing|property"


def pick(docs: DataFrame, forced: str | None = None) -> DataFrame:
    """``docs`` (text, themes, desk, primary_kind) with profile: that forced if it exists, else the first whose theme, words, desk or kind fit, else the generic one."""
    cases = []
    for p in PROFILES:
        test = F.lit(False)
        for t in p.themes:
            test = test | F.array_contains("themes", t)
        if p.pattern:
            test = test | Has(p.pattern).column(F.col("text"))
        test = test | F.col("desk").isin(*p.desks) | F.col("primary_kind").isin(*p.kinds) if p.desks else test
        cases.append((F.coalesce(test, F.lit(False)), F.lit(p.name)))
    found = first_of(cases, F.lit(GENERIC.name))
    if forced:
        found = F.coalesce(F.when(F.col(forced).isin(*[p.name for p in ALL]), F.col(forced)), found)
    return docs.withColumn("profile", found)


def profiles() -> list[tuple[str, str]]:
    """Names and labels of all profiles, for a reviewer to pick from."""
    return [(p.name, p.label) for p in ALL]


def _view() -> dict[str, Column]:
    """The facts a text's analysis speaks of, each null where the text has none."""
    instrument, deadline, scope, ban = (f.first(k) for k in ("instrument", "deadline", "scope", "prohibition"))
    cash = F.coalesce(F.try_element_at(F.filter(f.of("money"), lambda m: m["has_amount"]), F.lit(1)), f.first("money"))
    named = F.filter(f.of("actor"), lambda a: a["form"] != "unnamed")
    delegate = F.try_element_at(F.filter(f.of("actor"), lambda a: a["form"] == "unnamed"), F.lit(1))["value_en"]
    subjects = F.transform(F.slice(f.of("subject"), 1, 3), lambda s: s["value_en"])
    return {
        "instrument": without_article(instrument["value_en"]), "issued": F.when(instrument["issued"], F.lit("issued")), "deadline": deadline["value_en"], "amount": cash["amount_en"],
        "vehicle": cash["vehicle"], "scope": scope["value_en"], "ban": ban["value_en"], "delegate": delegate, "body": F.when(F.size(named) > 0, F.lit("named")),
        "subject": f.first("subject")["value_en"], "subjects": F.when(F.size(subjects) > 0, F.array_join(subjects, ", ")),
        "strained": F.when(F.exists(subjects, lambda s: s.rlike(STRAINED)), F.array_join(subjects, ", ")),
    }


def _filled(template: str, view: dict[str, Column]) -> Column:
    """The template with its facts, null if one is missing; a capital letter in braces is a capital in the text."""
    parts = []
    for literal, name in re.findall(r"([^{]*)(?:\{(\w+)\})?", template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            value = view[name.lower()]
            parts.append(capital(value) if name[0].isupper() else value)
    return F.concat(*parts)


def _piece(piece: Piece, view: dict[str, Column]) -> Column:
    shared = {"<stage>": _stage, "<funding>": _funding, "<capacity>": _capacity}
    return F.coalesce(*[shared[t](view) if t in shared else _filled(t, view) for t in piece])


def _stage(view: dict[str, Column]) -> Column:
    """What the document and its time say of how far it is."""
    out = F.when(view["issued"].isNotNull(), _filled("{Instrument} exists, so its text can be read instead of this report.", view))
    return F.coalesce(out, _filled("{Instrument} does not exist yet and is due {deadline}.", view), _filled("{Instrument} does not exist yet, and no time is given for it.", view))


def _funding(view: dict[str, Column]) -> Column:
    return F.coalesce(_filled("Payment is specified: {amount} through {vehicle}.", view), _filled("Payment is specified in size ({amount}) and not in channel.", view), _filled("Payment for {instrument} is not mentioned.", view))


def _capacity(view: dict[str, Column]) -> Column:
    delegated = F.when(view["body"].isNotNull(), _filled("Part of the work falls to {delegate}, whom nobody can name.", view))
    return F.coalesce(delegated, F.when(view["body"].isNull(), F.lit("Nobody in particular is made responsible.")))


def _likelihood(s: Scenario, view: dict[str, Column]) -> Column:
    if s.likely == ("",):
        return F.lit("medium")
    if s.likely == ("!",):
        return F.lit("low")
    test = F.lit(True)
    for name in s.likely:
        test = test & (view[name[1:]].isNull() if name[0] == "!" else view[name].isNotNull())
    return F.when(test, "medium").otherwise("low")


def scenario_cap() -> Column:
    """One scenario for one kind of hard fact or none, two for two, else three."""
    kinds = sum((F.when(F.size(f.of(k)) > 0, 1).otherwise(0) for k in ("instrument", "deadline", "money", "quantity", "scope", "prohibition")), F.lit(0))
    return F.greatest(F.lit(1), F.least(F.lit(3), kinds))


def four_pieces(scenarios: Column) -> Column:
    """Scenarios with an alternative and a falsifier, where one lacks them."""

    def whole(s: Column) -> Column:
        against = F.coalesce(F.concat(F.lit("The reverse of this is seen: "), F.nullif(s["trigger"], F.lit(""))), F.lit("A published text rules it out."))
        return s.withField("alternative", F.coalesce(F.nullif(s["alternative"], F.lit("")), F.lit(ALTERNATIVE))).withField("falsifier", F.coalesce(F.nullif(s["falsifier"], F.lit("")), against))

    return F.transform(scenarios, whole)


def _distinct(pieces: Column, most: int) -> Column:
    return F.slice(F.array_distinct(F.filter(pieces, lambda x: x.isNotNull() & (x != ""))), 1, most)


def _read(p: Profile, view: dict[str, Column], cap: Column) -> Column:
    made = [F.struct(_piece(s.label, view).alias("label"), _likelihood(s, view).alias("likelihood"), _piece(s.horizon, view).alias("horizon"), _piece(s.basis, view).alias("basis"), F.lit(s.trigger).alias("trigger"), F.lit(s.alternative).alias("alternative"), F.lit(s.falsifier).alias("falsifier")) for s in p.scenarios]
    so_what = F.array_join(_distinct(F.array(*[_piece(x, view) for x in p.so_what]), 5), " ")
    return F.struct(
        F.lit(p.label).alias("label"), F.lit(p.background).alias("background"),
        F.coalesce(F.nullif(so_what, F.lit("")), F.lit("Nothing in the excerpt says what would change.")).alias("so_what"),
        four_pieces(F.slice(F.array(*made).cast(f"array<{_SCENARIO}>"), F.lit(1), cap)).alias("scenarios"),
        _distinct(F.array(*[_piece(x, view) for x in p.watch]), 6).alias("watchpoints"), _distinct(F.array(*[_piece(x, view) for x in p.questions]), 5).alias("questions"),
    )


def analyse(docs: DataFrame) -> DataFrame:
    """``docs`` (facts, profile) and analysis: struct<label,background,so_what,scenarios,watchpoints,questions>."""
    facts = _view()

    def read(v: Column) -> Column:
        out = F.when(F.col("profile") == ALL[0].name, _read(ALL[0], {k: v[k] for k in facts}, v["cap"]))
        for p in ALL[1:]:
            out = out.when(F.col("profile") == p.name, _read(p, {k: v[k] for k in facts}, v["cap"]))
        return out

    # bound and no column of its own: each fact is found once and not once a mention
    return docs.withColumn("analysis", bind(F.struct(*[c.alias(k) for k, c in facts.items()], scenario_cap().alias("cap")), read))


def watchpoints(listed: Column, band: Column, as_of: Column) -> Column:
    """Up to eight distinct watchpoints, with one more where the date is unknown, relative or old."""
    newer = F.concat(F.lit("A text newer than "), F.coalesce(as_of.cast("string"), F.lit("?")), F.lit(" ("), band, F.lit(")"))
    fresh = F.when(band == "unknown", "The date of the text, which it does not give").when(band == "weak", "The date of the text, which it gives only in relation to today").when(band.isin("stale", "aging"), newer)
    return _distinct(F.concat(listed, F.array(fresh)), 8)


def enriched(scenarios: Column, rows: Column, most: int = 400) -> Column:
    """Scenarios with alternatives and falsifiers of ``rows`` (array<struct<index,alternative,falsifier>>), by index or else by place.

    All or nothing: as many rows as scenarios, no empty or overlong text, no alternative twice; else the scenarios stay.
    """
    by_place = F.transform(rows, lambda r, i: F.struct(F.coalesce(r["index"], i).alias("at"), F.trim(r["alternative"]).alias("a"), F.trim(r["falsifier"]).alias("x")))
    told = F.transform(scenarios, lambda s, i: F.try_element_at(F.filter(by_place, lambda r: r["at"] == i), F.lit(1)))
    fine = (F.size(rows) == F.size(scenarios)) & F.forall(told, lambda r: r.isNotNull() & F.length(r["a"]).between(1, most) & F.length(r["x"]).between(1, most))
    unique = F.size(F.array_distinct(F.transform(told, lambda r: r["a"]))) == F.size(scenarios)
    new = F.zip_with(scenarios, told, lambda s, r: s.withField("alternative", r["a"]).withField("falsifier", r["x"]))
    return F.when(F.coalesce(fine & unique, F.lit(False)), new).otherwise(scenarios)
