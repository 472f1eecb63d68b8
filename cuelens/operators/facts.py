"""Typed facts of texts: actors, instruments, deadlines, money, quantities, scopes, prohibitions, subjects.

Candidates are claimed in their kind's order, longer terms first, so a fact never overlaps a better one of its kind.
Offsets count code points. Every fact carries its verbatim value, an English rendering, the clause (``quote``) and
the sentence it stands in, all exact substrings. Word lists and patterns are a fact pack; nothing here is Python in
the rows' path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelens.functions.gloss import any_of, capital, first_of_catalog, listed, looked_up, render, with_article, without_article
from cuelens.functions.text import SENTENCE_BREAKS, SENTENCE_MOST, around, bind, spans
from cuelens.lexicon.mandarin_facts import MANDARIN_FACTS, MONTHS, FactPack

#: Columns of a fact; ``amount`` is in yuan, ``form`` an actor's (person, meeting, body, unnamed).
FACT = (
    "struct<start:int,end:int,kind:string,value:string,value_en:string,fragment:string,point:string,qualifier:string,form:string,has_amount:boolean,"
    "amount:decimal(38,2),amount_en:string,vehicle:string,type_en:string,issued:boolean,quote:string,sentence:string>"
)
_FIELDS = [x.split(":")[0] for x in FACT[7:-1].replace("decimal(38,2)", "decimal").split(",")]
_TYPES = {"start": "int", "end": "int", "amount": "decimal(38,2)", "has_amount": "boolean", "issued": "boolean"}
KINDS = ("actor", "instrument", "deadline", "money", "quantity", "scope", "prohibition", "subject")


def _fact(text: Column, kind: str, start: Column, value: Column, value_en: Column, fragment: tuple, point: tuple, **more: Column) -> Column:
    """A fact; ``fragment`` and ``point`` are what stands before and after its English value. Every part is computed once."""
    own = F.struct(start.cast("int").alias("start"), value.alias("value"), value_en.alias("value_en"), *[c.alias(k) for k, c in more.items()])
    said = lambda around_, e: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in (around_[0], e, *around_[1:])])

    def made(o: Column) -> Column:
        known = {k: o[k] for k in ("start", "value", "value_en", *more)} | {
            "end": o["start"] + F.length(o["value"]), "kind": F.lit(kind), "fragment": said(fragment, o["value_en"]), "point": said(point, o["value_en"]),
            "quote": around(text, o["start"], o["value"]), "sentence": around(text, o["start"], o["value"], SENTENCE_BREAKS, SENTENCE_MOST),
        }
        return F.struct(*[known.get(f, F.lit(None)).cast(_TYPES.get(f, "string")).alias(f) for f in _FIELDS])

    return bind(own, made)


def _ranked(found: Column, terms) -> Column:
    """Spans in order of claim: longer terms first, then catalog order, then place."""
    return _in_order(found, sorted(terms, key=len, reverse=True))


def _in_order(found: Column, terms) -> Column:
    """Spans by the order of their terms, then by place."""
    rank = lambda value: looked_up({t: str(i) for i, t in enumerate(terms)}, value).cast("int")
    return F.array_sort(F.transform(found, lambda s: F.struct(rank(s["value"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))))


def _claimed(candidates: Column, kind: str) -> Column:
    """Candidates (bare_start, bare_end, start, end, ...) in order, each kept if its bare span meets no span kept before."""
    meets = lambda done, x: F.exists(done, lambda k: (x["bare_start"] < k["end"]) & (x["bare_end"] > k["start"]))
    return F.aggregate(candidates, F.array().cast(f"array<{kind}>"), lambda done, x: F.when(meets(done, x), done).otherwise(F.concat(done, F.array(x))))


_BARE = "struct<bare_start:int,bare_end:int,start:int,end:int,term:string,text:string>"


def _bare(start: Column, end: Column, at: Column, upto: Column, term: Column, value: Column) -> Column:
    return F.struct(start.alias("bare_start"), end.alias("bare_end"), at.alias("start"), upto.alias("end"), term.alias("term"), value.alias("text"))


def _left_of(text: Column, at: Column, most: int, pack: FactPack, stops: tuple[str, ...]) -> Column:
    """The letters right before a place, ``most`` of them, without all up to the last of each stop in turn."""
    left = F.regexp_extract(F.substring(text, F.greatest(F.lit(1), at - most + 1), F.least(at, F.lit(most))), rf"[{pack.letter}]{{0,{most}}}\z", 0)
    for stop in stops:
        left = F.substring_index(left, stop, -1)
    return left


def _missing(found: Column, text: Column, term: str) -> Column:
    """Place of a term's first occurrence if no span of ``found`` meets it, else null."""
    at = F.instr(text, F.lit(term)) - 1
    return F.when((at >= 0) & ~F.exists(found, lambda k: (at < k["end"]) & (at + len(term) > k["start"])), at)


def actors(text: Column, pack: FactPack) -> Column:
    """Named bodies and meetings, with a role that follows one; placeholders at their first occurrence."""
    named = {**pack.bodies, **pack.meetings}
    roles = "|".join(pack.roles)

    def made(s: Column) -> Column:
        body = F.regexp_extract(s["value"], f"^(?:{any_of(named)})", 0)
        role = F.substring(s["value"], F.length(body) + 1, F.length(s["value"]))
        has = F.length(role) > 0
        english = F.when(has, F.concat(looked_up(named, body), F.lit(" "), looked_up(pack.roles, role))).otherwise(looked_up(named, body))
        form = F.when(has, "person").when(body.isin(*pack.meetings), "meeting").otherwise("body")
        return _fact(text, "actor", s["start"], s["value"], english, ("acting body: ",), ("Names the acting body — ", "."), form=form)

    def all_of(found: Column) -> Column:
        vague = []
        for term, english in pack.unnamed.items():
            at = _missing(found, text, term)
            e = F.lit(english)
            vague.append(F.when(at.isNotNull(), _fact(text, "actor", at, F.lit(term), e, ("acting body left open: ",), ("Leaves the acting body unnamed — ", "."), form=F.lit("unnamed"))))
        return F.concat(F.transform(found, made), F.array_compact(F.array(*vague)))

    return bind(spans(text, f"(?:{any_of(named)})(?:{roles})?"), all_of)


def instruments(text: Column, pack: FactPack) -> Column:
    """Documents: a kind with the letters before it that belong to its title, and whether it is out already."""

    def candidate(s: Column) -> Column:
        left = _left_of(text, s["start"], 12, pack, pack.modifier_stops)
        return _bare(s["start"], s["end"], s["start"] - F.length(left), s["end"], s["value"], F.concat(left, s["value"]))

    def made(c: Column) -> Column:
        modifier = F.left(c["text"], F.length(c["text"]) - F.length(c["term"]))
        plain = looked_up(pack.instruments, c["term"])

        def told(whole: Column) -> Column:
            part = render(modifier, pack.glossary)["en"]
            english = F.when((modifier != "") & (whole["covered"] >= 0.85) & (whole["en"] != ""), whole["en"]).when(part != "", F.concat(part, F.lit(" "), without_article(plain))).otherwise(plain)
            value_en = with_article(english, c["term"].isin(*pack.plural))
            issued = around(text, c["start"], c["text"]).rlike(pack.issued)
            state = F.when(issued, " (already issued)").otherwise(" (promised, not yet published)")
            point = F.when(issued, "Names an instrument already issued — ").otherwise("Names the instrument still to be issued — ")
            return _fact(text, "instrument", c["start"], c["text"], value_en, ("instrument: ", state), (point, "."), type_en=without_article(plain), issued=issued)

        return bind(render(c["text"], pack.glossary), told)

    found = _ranked(spans(text, any_of(pack.instruments)), pack.instruments)
    return F.transform(_claimed(F.transform(found, candidate).cast(f"array<{_BARE}>"), _BARE), made)


def deadlines(text: Column, pack: FactPack) -> Column:
    """Years, with month and relation, and relative phrases at their first occurrence."""

    def part(s: Column, k: int) -> Column:
        return F.regexp_extract(s["value"], pack.deadline, k)

    def made(s: Column) -> Column:
        month = F.element_at(F.array(*map(F.lit, MONTHS)), F.nullif(part(s, 2), F.lit("")).cast("int"))
        when = F.concat_ws(" ", month, part(s, 1))
        ends, rel = part(s, 3) != "", part(s, 4)
        before = rel.isin("前", "以前", "之前")
        lead = F.when(ends & before, "by end-").when(ends, "end-").when(before, "before ").when(rel == "以来", "since ").when(rel == "起", "from ").when(rel == "后", "after ").otherwise("in ")
        english = F.concat(lead, when)
        return _deadline(s["start"], s["value"], english)

    def _deadline(start: Column, value: Column, english: Column) -> Column:
        return _fact(text, "deadline", start, value, english, ("deadline: ",), ("Sets a time marker — ", "."))

    def all_of(found: Column) -> Column:
        rest = []
        claimed = found
        for term, english in pack.relative.items():
            at = _missing(claimed, text, term)
            rest.append(F.when(at.isNotNull() & ~_within_earlier(text, term, pack.relative), _deadline(at, F.lit(term), F.lit(english))))
        return F.concat(F.transform(found, made), F.array_compact(F.array(*rest)))

    return bind(spans(text, pack.deadline), all_of)


def _within_earlier(text: Column, term: str, table: dict[str, str]) -> Column:
    """Whether the first occurrence of a term meets that of one before it in the table."""
    at, out = F.instr(text, F.lit(term)), F.lit(False)
    for other in table:
        if other == term:
            return out
        if set(other) & set(term):
            there = F.instr(text, F.lit(other))
            out = out | ((there > 0) & (at < there + len(other)) & (at + len(term) > there))
    return out


def yuan(amount: Column) -> Column:
    """An amount in words: trillions, billions, millions, or with separators."""
    scaled = lambda n, word: F.concat(F.lit("RMB "), _whole(amount / n), F.lit(f" {word}"))
    return F.when(amount >= 10**12, scaled(10**12, "trillion")).when(amount >= 10**9, scaled(10**9, "billion")).when(amount >= 10**6, scaled(10**6, "million")).otherwise(F.concat(F.lit("RMB "), F.regexp_replace(F.format_number(amount, 2), r"\.?0+$", "")))


def _whole(number: Column) -> Column:
    text = F.round(number, 2).cast("decimal(38,2)").cast("string")
    return F.when(text.endswith(".00"), F.substring_index(text, ".", 1)).otherwise(F.regexp_replace(text, "0$", ""))


def money(text: Column, pack: FactPack) -> Column:
    """Amounts: in a unit of yuan, or in another beside a funding word of the same clause; with no amount at all, the first funding word."""
    quals, units = "|".join(pack.qualifiers), any_of(pack.units)
    pattern = rf"({quals})?\s*(\d+(?:\.\d+)?)\s*({units})"

    def made(s: Column) -> Column:
        qual, number, unit = (F.regexp_extract(s["value"], pattern, k) for k in (1, 2, 3))
        vehicle = without_article(first_of_catalog(around(text, s["start"], s["value"]), pack.vehicles))
        amount = (number.cast("decimal(20,4)") * looked_up({u: str(n) for u, n in pack.units.items()}, unit).cast("decimal(14,0)")).cast("decimal(38,2)")
        plain = bind(amount, yuan)
        words = {k: v[1] for k, v in pack.qualifiers.items()}
        amount_en = F.when(qual != "", F.concat(looked_up(words, qual), F.lit(" "), plain)).otherwise(plain)
        value_en = F.when(vehicle.isNotNull(), F.concat(amount_en, F.lit(" in "), vehicle)).otherwise(amount_en)
        fact = _fact(
            text, "money", s["start"], s["value"], value_en, ("funding: ",), ("Attaches a funding line — ", "."),
            qualifier=looked_up({k: v[0] for k, v in pack.qualifiers.items()}, F.nullif(qual, F.lit(""))), has_amount=F.lit(True), amount=amount, amount_en=amount_en, vehicle=vehicle,
        )
        return F.when(unit.endswith("元") | vehicle.isNotNull(), fact)

    def or_vehicle(found: Column) -> Column:
        bare = []
        for term, english in pack.vehicles.items():
            value_en = F.lit(f"{english} (no amount stated)")
            fact = _fact(text, "money", F.instr(text, F.lit(term)) - 1, F.lit(term), value_en, ("funding: ",), (F.lit(f"Names a funding vehicle without an amount — {english}: "), "."), has_amount=F.lit(False), vehicle=without_article(F.lit(english)))
            bare.append(F.when(F.contains(text, F.lit(term)), fact))
        return F.when(F.size(found) > 0, found).otherwise(F.array_compact(F.array(F.coalesce(*bare))))

    return bind(F.array_compact(F.transform(spans(text, pattern), made)), or_vehicle)


def quantities(text: Column, pack: FactPack, amounts: Column) -> Column:
    """Numbers with a unit that no amount covers; units of ten thousand are written out."""
    pattern = rf"({'|'.join(pack.quantity_qualifiers)})?\s*(\d+(?:\.\d+)?)\s*({any_of(pack.quantities)})"
    words = {u: w for u, (_, w) in pack.quantities.items()}

    def made(s: Column) -> Column:
        qual, number, unit = (F.regexp_extract(s["value"], pattern, k) for k in (1, 2, 3))
        times = looked_up({u: str(n) for u, (n, _) in pack.quantities.items()}, unit).cast("int")
        shown = F.when(times > 1, _whole_number(number.cast("decimal(20,6)") * times)).otherwise(number)
        plain = F.concat(shown, looked_up(words, unit))
        value_en = F.when(qual != "", F.concat(looked_up({k: v[1] for k, v in pack.qualifiers.items()}, qual), F.lit(" "), plain)).otherwise(plain)
        return _fact(text, "quantity", s["start"], s["value"], value_en, ("quantified figure: ",), ("States a quantified figure — ", "."), qualifier=looked_up({k: v[0] for k, v in pack.qualifiers.items()}, F.nullif(qual, F.lit(""))))

    free = F.filter(spans(text, pattern), lambda s: ~F.exists(amounts, lambda m: (s["start"] < m["end"]) & (s["end"] > m["start"])))
    return F.transform(free, made)


def _whole_number(number: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def scopes(text: Column, pack: FactPack) -> Column:
    """What bounds delivery; a pilot with the letters before it that name it."""
    def candidate(s: Column) -> Column:
        left = F.when(s["value"] == pack.pilot, _left_of(text, s["start"], 14, pack, pack.scope_stops)).otherwise("")
        return _bare(s["start"], s["end"], s["start"] - F.length(left), s["end"], s["value"], F.concat(left, s["value"]))

    def made(c: Column) -> Column:
        def told(subject: Column) -> Column:
            pilot = F.when((subject["en"] != "") & (subject["covered"] >= 0.6), F.concat(F.lit("a "), subject["en"], F.lit(" pilot"))).otherwise("a pilot (scope not translated — see quoted excerpt)")
            value_en = F.when(c["term"] == pack.pilot, pilot).otherwise(looked_up(pack.scopes, c["term"]))
            return _fact(text, "scope", c["start"], c["text"], value_en, ("scope: ",), ("Bounds delivery — ", "."))

        return bind(render(F.left(c["text"], F.length(c["text"]) - F.length(c["term"])), pack.glossary), told)

    keyed = _in_order(spans(text, any_of(pack.scopes)), pack.scopes)
    return F.transform(_claimed(F.transform(keyed, candidate).cast(f"array<{_BARE}>"), _BARE), made)


def prohibitions(text: Column, pack: FactPack) -> Column:
    """Bans with up to 12 letters of what they ban, and red lines that no ban covers."""
    def candidate(s: Column) -> Column:
        tail = F.regexp_extract(F.substring(text, s["end"] + 1, F.lit(12)), f"^[{pack.letter}]*", 0)
        return _bare(s["start"], s["end"], s["start"], s["end"] + F.length(tail), s["value"], F.concat(s["value"], tail))

    def made(c: Column) -> Column:
        def ban(topic: Column) -> Column:
            value_en = F.concat(looked_up(pack.bans, c["term"]), F.lit(" "), F.when((topic["en"] != "") & (topic["covered"] >= 0.6), topic["en"]).otherwise("a practice named only in the Mandarin excerpt"))
            return _fact(text, "prohibition", c["start"], c["text"], value_en, ("prohibition: the text ",), ("States a prohibition — the text ", "."))

        def line(topic: Column) -> Column:
            value_en = F.when((topic["en"] != "") & (topic["covered"] >= 0.5), F.concat(F.lit("states a red line on "), topic["en"])).otherwise("states a red line (topic named only in the Mandarin excerpt)")
            return _fact(text, "prohibition", c["start"], c["text"], value_en, ("red line: the text ",), ("States a red line — the text ", "."))

        tail = F.substring(c["text"], F.length(c["term"]) + 1, F.length(c["text"]))
        return F.when(c["term"] == "", bind(render(F.regexp_extract(c["text"], pack.red_line, 3), pack.glossary), line)).otherwise(bind(render(tail, pack.glossary), ban))

    keyed = _in_order(spans(text, any_of(pack.bans)), pack.bans)
    leads = F.transform(keyed, candidate).cast(f"array<{_BARE}>")
    lines = F.transform(spans(text, pack.red_line), lambda s: _bare(s["start"], s["end"], s["start"], s["end"], F.lit(""), s["value"])).cast(f"array<{_BARE}>")
    return F.transform(_claimed(F.concat(leads, lines), _BARE), made)


def subjects(text: Column, pack: FactPack) -> Column:
    """Subjects at their first occurrence, longer ones first, each English name once."""
    kind = "struct<bare_start:int,bare_end:int,start:int,end:int,term:string,text:string>"
    ordered = sorted(pack.subjects, key=len, reverse=True)
    found = []
    for t in ordered:
        at = F.instr(text, F.lit(t)) - 1
        found.append(F.when(at >= 0, _bare(at, at + len(t), at, at + len(t), F.lit(pack.glossary[t]), F.lit(t))))
    clash = lambda done, x: F.exists(done, lambda k: (k["term"] == x["term"]) | ((x["bare_start"] < k["end"]) & (x["bare_end"] > k["start"])))
    kept = F.aggregate(F.array_compact(F.array(*found)).cast(f"array<{kind}>"), F.array().cast(f"array<{kind}>"), lambda done, x: F.when(clash(done, x), done).otherwise(F.concat(done, F.array(x))))
    return F.transform(kept, lambda c: _fact(text, "subject", c["start"], c["text"], c["term"], ("subject: ",), ("Names a subject in scope — ", ".")))


def facts(docs: DataFrame, pack: FactPack = MANDARIN_FACTS) -> DataFrame:
    """``docs`` with ``facts`` of all kinds in order of their place, named_actor and funded."""
    text = F.col("text")
    rows = docs.withColumn("_money", money(text, pack).cast(f"array<{FACT}>"))
    parts = [actors(text, pack), instruments(text, pack), deadlines(text, pack), F.col("_money"), quantities(text, pack, F.col("_money")), scopes(text, pack), prohibitions(text, pack), subjects(text, pack)]
    flat = F.concat(*[p.cast(f"array<{FACT}>") for p in parts])
    placed = F.array_sort(F.transform(flat, lambda f: F.struct(f["start"].alias("at"), looked_up({k: str(i) for i, k in enumerate(KINDS)}, f["kind"]).cast("int").alias("ord"), f["end"].alias("upto"), f.alias("f"))))
    rows = rows.withColumn("facts", F.transform(placed, lambda p: p["f"])).drop("_money")
    return rows.withColumns({"named_actor": F.exists("facts", lambda f: (f["kind"] == "actor") & (f["form"] != "unnamed")), "funded": F.exists("facts", lambda f: (f["kind"] == "money") & f["has_amount"])})


def of(kind: str, facts: Column | str = "facts") -> Column:
    return F.filter(facts, lambda f: f["kind"] == kind)


def first(kind: str, facts: Column | str = "facts") -> Column:
    return F.try_element_at(of(kind, facts), F.lit(1))


def nearest_actor(facts: Column, at: Column) -> Column:
    """The named actor nearest to a place; among those within 40 characters of the nearest a body goes first, then the nearer, then the earlier."""
    named = F.filter(facts, lambda f: (f["kind"] == "actor") & (f["form"] != "unnamed"))
    least = F.array_min(F.transform(named, lambda f: F.abs(f["start"] - at)))
    near = F.filter(named, lambda f: F.abs(f["start"] - at) <= least + 40)
    keyed = F.array_sort(F.transform(near, lambda f: F.struct(F.when(f["form"] == "body", 0).otherwise(1).alias("b"), F.abs(f["start"] - at).alias("far"), f["start"].alias("at"), f["value_en"].alias("en"))))
    return F.try_element_at(keyed, F.lit(1))["en"]


# Kinds whose absence is told, in order.
ABSENCES = (("instrument", "a named instrument"), ("money", "a funding line"), ("deadline", "a deadline or time marker"), ("quantity", "a quantified target"), ("scope", "a pilot or scope boundary"))
MISSING = (("instrument", "no document or measure is named"), ("money", "no amount or funding channel appears"), ("deadline", "no date is given"), ("scope", "no pilot or geographic scope is set"), ("quantity", "no quantified target is stated"))


def _absent(table) -> Column:
    return F.array_compact(F.array(*[F.when(F.size(of(k)) == 0, label) for k, label in table]))


def missing_facts() -> Column:
    """One sentence of up to four kinds of fact that ``facts`` lacks."""
    gaps = F.slice(_absent(MISSING), 1, 4)
    return F.when(F.size(gaps) > 0, F.concat(F.lit("In this excerpt "), F.array_join(gaps, ", "), F.lit("."))).otherwise("This excerpt states no actionable commitment.")


def headline(hard: Column, pack: FactPack = MANDARIN_FACTS) -> Column:
    """A claim of few words: instrument, money, official action, deadline, ban, actor, in this order; ``hard`` are the adopted nuggets."""
    facts = F.col("facts")

    def actor(f: Column) -> Column:
        return capital(nearest_actor(facts, f["start"]))

    def phrase(f: Column, with_actor: Column, alone: Column) -> Column:
        who = actor(f)
        return F.when(f.isNotNull(), F.when(who.isNotNull(), F.concat(who, F.lit(" "), with_actor)).otherwise(alone))

    instrument, cash, deadline, ban = first("instrument"), F.try_element_at(F.filter(of("money"), lambda f: f["has_amount"]), F.lit(1)), first("deadline"), first("prohibition")
    verb = F.when(instrument["issued"], "Issues ").otherwise("Signals Plan to Issue ")
    goal = F.coalesce(F.concat(F.lit(" for "), first("scope")["value_en"]), F.lit(""))
    action = first_of_catalog(F.try_element_at(F.filter(hard, lambda n: n["kind"].isin("official_action", "named_campaign")), F.lit(1))["evidence"], pack.actions)
    named = capital(F.try_element_at(F.filter(facts, lambda f: (f["kind"] == "actor") & (f["form"] != "unnamed")), F.lit(1))["value_en"])
    return F.coalesce(
        phrase(instrument, F.concat(verb, instrument["value_en"]), F.concat(verb, instrument["value_en"])),
        phrase(cash, F.concat(F.lit("Commits "), cash["value_en"], goal), F.concat(cash["value_en"], F.lit(" Committed"), goal)),
        F.when(named.isNotNull(), F.concat(named, F.lit(" "), action)).otherwise(capital(action)),
        phrase(deadline, F.concat(F.lit("Sets Deadline "), deadline["value_en"]), F.concat(F.lit("Deadline Set "), deadline["value_en"])),
        phrase(ban, ban["value_en"], capital(ban["value_en"])),
        F.concat(named, F.lit(" Restates Policy Priorities")),
        F.lit("Public Mandarin Source — Policy Signal"),
    )


def _values(found: Column, most: int) -> Column:
    return listed(F.transform(F.slice(found, 1, most), lambda f: f["value_en"]))


def what(lead: Column | None = None) -> Column:
    """What the facts establish, in English; then what is banned, then what is not said."""
    acting = lambda *forms: F.filter(of("actor"), lambda f: f["form"].isin(*forms))
    people, meetings, bodies = acting("person"), acting("meeting"), acting("body")
    parts = F.array(
        F.when(F.size(people) > 0, F.concat(_values(people, 3), F.lit(" statement"))), F.when(F.size(meetings) > 0, F.concat(_values(meetings, 2), F.lit(" readout"))),
        F.when((F.size(bodies) > 0) & (F.size(people) == 0), _values(bodies, 2)),
    )
    vague = F.concat(F.lit("Attributed only to "), first("actor")["value_en"])
    who = F.when(F.col("named_actor"), listed(parts)).otherwise(vague)
    instrument, deadline, scope, cash = first("instrument"), first("deadline"), first("scope"), F.filter(of("money"), lambda f: f["has_amount"])
    verb = F.when(instrument["issued"], " issued").otherwise(" to be issued")
    document = F.when(instrument.isNotNull(), F.concat(instrument["value_en"], verb, F.coalesce(F.concat(F.lit(" "), deadline["value_en"]), F.lit("")))).when(deadline.isNotNull(), F.concat(F.lit("time marker set for "), deadline["value_en"], F.lit(", with no document title named")))
    funds = F.when(F.size(cash) > 0, F.concat(_values(cash, 2), F.coalesce(F.concat(F.lit(" for "), scope["value_en"]), F.lit("")))).when(scope.isNotNull(), F.concat(F.lit("delivery bounded to "), scope["value_en"])).otherwise(first("money")["value_en"])
    figures = F.when(F.size(of("quantity")) > 0, F.concat(F.lit("quantified figures: "), _values(of("quantity"), 3)))
    carried = instrument.isNotNull() | (F.size(cash) > 0) | scope.isNotNull()
    about = F.when((F.size(of("subject")) > 0) & ~carried, F.concat(F.lit("named subjects: "), _values(of("subject"), 4)))
    segments = F.filter(F.array(who, document, funds, figures, about), lambda x: x.isNotNull() & (x != ""))
    told = F.when(F.size(segments) > 0, capital(F.concat(lead if lead is not None else F.lit(""), F.array_join(segments, "; "), F.lit("."))))
    bans = F.when(F.size(of("prohibition")) > 0, F.concat(F.lit("The text also "), _values(of("prohibition"), 2), F.lit(".")))
    body = F.when(~F.col("named_actor") & (F.size(of("actor")) > 0), F.array(F.lit("an implementing body"))).otherwise(F.array().cast("array<string>"))
    gaps = F.concat(body, _absent(ABSENCES))
    unsaid = F.when(F.size(gaps) > 0, F.concat(F.lit("Not specified in the excerpt: "), listed(gaps), F.lit(".")))
    return F.concat_ws(" ", told, bans, unsaid)


def rejection() -> Column:
    """Why a text was not taken: what it names and what it lacks."""
    party = F.when(F.size(of("actor")) > 0, F.concat(F.lit("acting party ("), first("actor")["value_en"], F.lit(")")))
    about = F.when(F.size(of("subject")) > 0, F.concat(F.lit("subject ("), _values(of("subject"), 3), F.lit(")")))
    named = F.when(party.isNotNull() | about.isNotNull(), F.concat(F.lit("Named in the paste: "), listed(F.array(party, about)), F.lit(".")))
    gaps = _absent(ABSENCES)
    lacks = F.when(F.size(gaps) > 0, F.concat(F.lit("Missing: "), listed(gaps), F.lit(".")))
    return F.concat_ws(" ", F.lit("Not adopted — this excerpt carries no verifiable detail."), named, lacks)


def digest(most: int = 4) -> Column:
    """array<struct<point,quote>>: facts by sentence in order of the first, up to four distinct fragments each, ``most`` sentences."""
    facts = F.col("facts")
    quotes = F.slice(F.array_distinct(F.transform(facts, lambda f: f["sentence"])), 1, most)

    def row(q: Column) -> Column:
        told = F.slice(F.array_distinct(F.transform(F.filter(facts, lambda f: f["sentence"] == q), lambda f: f["fragment"])), 1, 4)
        return F.struct(F.concat(F.lit("Establishes "), F.array_join(told, "; "), F.lit(".")).alias("point"), q.alias("quote"))

    return F.transform(quotes, row)


def overlapping_hard(rows: Column, hard: Column) -> Column:
    """Digest rows whose quote and a hard nugget's evidence hold one another, the evidence by its first 12 characters."""
    return F.filter(rows, lambda r: F.exists(hard, lambda h: F.contains(h["evidence"], r["quote"]) | F.contains(r["quote"], F.left(h["evidence"], F.lit(12)))))
