"""Column builders over texts: offsets, spans, claims, n-grams. Offsets count code points from 0."""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelens.functions.dialect import branches, java, needs_digit, words


#: Alternatives of a pattern up to which the fixed text of each is looked for.
MOST_BRANCHES = 16


@dataclass(frozen=True)
class Marked:
    """A text whose ``marked`` column tells of some alternatives whether they match; those need not be looked for again."""

    text: Column
    marks: Column
    names: frozenset[str]


def _mark(branch: str) -> str:
    return f"m{zlib.crc32(branch.encode()):08x}"


def marked(rows: DataFrame, patterns: Iterable[str]) -> DataFrame:
    """``rows`` (text) with marks: whether each alternative of the patterns matches, looked for once a row however many rules ask.

    Alternatives that need a digit are looked for in texts with one. The text must stay as it is while marks are read.
    """
    parts = {_mark(part): part for p in patterns for part, _, _ in branches(p)}
    text = F.col("text")

    def all_(digit: Column) -> Column:
        tests = {k: digit & holds(text, p) if needs_digit(p) else holds(text, p) for k, p in sorted(parts.items())}
        return F.struct(*[F.coalesce(test, F.lit(False)).alias(k) for k, test in tests.items()])

    return held(rows, "marks", bind(text.rlike(java(r"\d")), all_))


def seen(rows: DataFrame) -> Column | Marked:
    """The text of ``rows``, with its marks where there are some."""
    if "marks" not in rows.columns:
        return F.col("text")
    return Marked(F.col("text"), F.col("marks"), frozenset(rows.schema["marks"].dataType.names))


def plain(text: Column | Marked) -> Column:
    return text.text if isinstance(text, Marked) else text


def known(text: Column | Marked, pattern: str) -> Column | None:
    """Whether the pattern matches a text, by its marks; none where they do not tell of all alternatives."""
    names = [_mark(part) for part, _, _ in branches(pattern)] if isinstance(text, Marked) else []
    return reduce(or_, [text.marks[n] for n in names]) if names and text.names.issuperset(names) else None


def possible(text: Column | Marked, pattern: str) -> Column | None:
    """Whether the text holds what a match of one of the alternatives must hold; none where that is not known of all."""
    told = known(text, pattern)
    if told is not None:
        return told
    text = plain(text)
    parts = branches(pattern)
    if len(parts) > MOST_BRANCHES or not all(sure for _, sure, _ in parts):
        return None
    return reduce(or_, [F.contains(text, F.lit(sure)) for _, sure, _ in parts])


def _between_blanks(text: Column, word: str) -> Column:
    return F.contains(text, F.lit(f" {word} ")) | F.startswith(text, F.lit(f"{word} ")) | F.endswith(text, F.lit(f" {word}")) | (text == word)


def holds(text: Column | Marked, pattern: str) -> Column:
    """Whether the pattern matches: by its marks or fixed texts first, and by the regex of an alternative only where its own occur."""
    told = known(text, pattern)
    if told is not None:
        return told
    text = plain(text)
    parts = branches(pattern)
    if len(parts) > MOST_BRANCHES:
        return text.rlike(java(pattern))
    tests = [F.contains(text, F.lit(sure)) for _, sure, whole in parts if whole]
    tests += [F.contains(text, F.lit(sure)) & text.rlike(java(part)) for part, sure, whole in parts if sure and not whole]
    tests += [_between_blanks(text, w) for part, _, _ in parts for w in words(part)]
    open_ = [part for part, sure, _ in parts if not sure and not words(part)]
    return reduce(or_, [*tests, text.rlike(java("|".join(open_)))] if open_ else tests)


def matches(text: Column | Marked, pattern: str) -> Column:
    """All matches, in order; none for null."""
    found, none = F.regexp_extract_all(plain(text), F.lit(java(pattern)), F.lit(0)), F.array().cast("array<string>")
    may = possible(text, pattern)
    return F.coalesce(found if may is None else F.when(may, found), none)


def found_text(text: Column, pattern: str) -> Column:
    """The first match, empty without one and null for null; a pattern that is plain text is its own."""
    (_, sure, whole), *more = branches(pattern)
    return F.lit(sure) if whole and not more else F.regexp_extract(text, java(pattern), 0)


def first_match(text: Column | Marked, pattern: str) -> Column:
    """The first match, or the empty string."""
    found, may = F.regexp_extract(plain(text), java(pattern), 0), possible(text, pattern)
    return F.coalesce(found if may is None else F.when(may, found), F.lit(""))


SPAN = "struct<start:int,end:int,value:string>"
#: Matches whose places are summed up together; places of stretches are summed before.
STRETCH = 256


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def held(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is computed once a row, however many of its fields are taken later: a projection would be copied into each of them."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>> of all matches; the pattern must not match the empty string.

    A text without a match is only tested for one. Places are running sums within stretches of ``STRETCH`` matches and
    over stretches, so the work grows little faster than the matches.
    """
    empty = F.array().cast(f"array<{SPAN}>")
    found = F.zip_with(F.split(text, java(pattern), -1), matches(text, pattern), lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("value")))
    found = F.filter(found, lambda x: x["value"].isNotNull())

    def within(part: Column) -> Column:
        def add(done: Column, x: Column) -> Column:
            start = F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0)) + x["gap"]
            return F.concat(done, F.array(F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["value"].alias("value"))))

        return F.aggregate(part, empty, add)

    def shifted(parts: Column) -> Column:
        def add(done: Column, part: Column) -> Column:
            by = done["end"]
            moved = F.transform(part, lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["value"].alias("value")))
            return F.struct((by + F.element_at(part, -1)["end"]).alias("end"), F.concat(done["parts"], F.array(moved)).alias("parts"))

        first = F.struct(F.lit(0).alias("end"), F.array().cast(f"array<array<{SPAN}>>").alias("parts"))
        return F.flatten(F.aggregate(parts, first, add, lambda d: d["parts"]))

    def placed(all_: Column) -> Column:
        of = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / STRETCH).cast("int")), lambda k: within(F.slice(all_, k * STRETCH + 1, F.lit(STRETCH))))
        return F.when(F.size(all_) > 0, shifted(of)).otherwise(empty)

    return F.when(F.coalesce(holds(text, pattern), F.lit(False)), bind(found, placed)).otherwise(empty)


def first_spans(text: Column | Marked, pattern: str, most: int) -> Column:
    """array<struct<start,end,value>> of the first ``most`` distinct matches, each at its first place; the pattern must not match the empty string.

    The text is split up to the last of those places and no further; a text without a match is not split.
    """
    empty = F.array().cast(f"array<{SPAN}>")

    def at(x: Column) -> Column:
        places = F.transform(F.slice(F.array_distinct(x), 1, most), lambda v: F.array_position(x, v).cast("int"))
        return bind(F.struct(places.alias("places"), F.split(plain(text), java(pattern), F.element_at(places, -1) + 1).alias("gaps")), lambda s: placed(x, s))

    def placed(x: Column, s: Column) -> Column:
        before = lambda p: F.length(F.array_join(F.slice(s["gaps"], F.lit(1), p), "")) + F.length(F.array_join(F.slice(x, F.lit(1), p - 1), ""))
        span = lambda start, v: F.struct(start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value"))
        return F.transform(s["places"], lambda p: bind(before(p), lambda b: span(b, F.element_at(x, p))))

    return bind(matches(text, pattern), lambda x: F.when(F.size(x) > 0, at(x)).otherwise(empty))


def claim(candidates: Column, kind: str = "struct<start:int,end:int,value:string>") -> Column:
    """Candidates in order of priority, each kept if it overlaps none kept before it."""
    clash = lambda done, x: F.exists(done, lambda k: (x["start"] < k["end"]) & (x["end"] > k["start"]))
    return F.aggregate(candidates, F.array().cast(f"array<{kind}>"), lambda done, x: F.when(clash(done, x), done).otherwise(F.concat(done, F.array(x))))


# What ends a clause and a sentence, the most characters of each, and what is trimmed from its ends.
CLAUSE_BREAKS, CLAUSE_MOST = "。！？；，、：·\n\r\t　,;:!?…", 52
SENTENCE_BREAKS, SENTENCE_MOST = "。！？；\n\r", 96
TRIMMED = "。！？；，、：·\n\r\t　 ,;:!?…“”\"'‘’()（）"


def around(text: Column, start: Column, value: Column, breaks: str = CLAUSE_BREAKS, most: int = CLAUSE_MOST) -> Column:
    """The stretch around the span ``value`` at ``start`` up to the nearest break on either side, trimmed of ``TRIMMED``.

    One of more than ``most`` characters begins with the span itself and is cut behind, not within the span; so it
    never begins in the middle of a phrase. Only ``most`` + 1 characters on either side are looked at.
    """
    size = F.length(value)
    left = F.regexp_replace(F.substring(text, F.greatest(F.lit(1), start - most), F.least(start, F.lit(most + 1))), f"(?s)^.*[{breaks}]", "")
    right = F.concat(value, F.regexp_extract(F.substring(text, start + size + 1, F.lit(most + 1)), f"^[^{breaks}]*", 0))
    cut = lambda x: F.when(F.length(x["left"]) + F.length(x["right"]) <= most, F.concat(x["left"], x["right"])).otherwise(F.substring(x["right"], F.lit(1), F.greatest(F.lit(most), size)))
    whole = bind(F.struct(left.alias("left"), right.alias("right")), cut)
    return bind(F.btrim(whole, F.lit(TRIMMED)), lambda w: F.when(w != "", w).otherwise(value))


def around_sql(text: str, start: str, value: str, breaks: str = CLAUSE_BREAKS, most: int = CLAUSE_MOST) -> str:
    """The same rule as an SQL text, from the whole text."""
    left = f"regexp_extract(substr({text}, 1, {start}), '[^{breaks}]*$')"
    right = f"({value} || regexp_extract(substr({text}, {start} + length({value}) + 1), '^[^{breaks}]*'))"
    trimmed = "[" + TRIMMED.replace("'", "''") + "]"
    whole = f"CASE WHEN length({left}) + length({right}) <= {most} THEN {left} || {right} ELSE substr({right}, 1, greatest({most}, length({value}))) END"
    return f"coalesce(nullif(regexp_replace({whole}, '^{trimmed}+|{trimmed}+$', '', 'g'), ''), {value})"


def char_grams(text: Column, n: int, of: str = r"\p{IsHan}") -> Column:
    """Distinct n-grams of characters within runs of the class ``of``."""
    runs = F.regexp_extract_all(text, F.lit(f"{of}{{{n},}}"), F.lit(0))
    grams = F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: F.substring(r, i, F.lit(n))))
    return F.array_distinct(F.flatten(grams))


def most_specific(terms: Column) -> Column:
    """Terms that no other term contains."""
    return F.filter(terms, lambda t: ~F.exists(terms, lambda o: (o != t) & F.contains(o, t)))


def placeholders(text: Column, labels: Column, name: str = "paste") -> Column:
    """``name-N`` replaced by the N-th label (from 1), in one pass; out of range stays."""
    pattern = f"{name}-\\d+"
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def fill(m: Column) -> Column:
        n = F.substring(m, len(name) + 2, 9).try_cast("int")
        return F.when(n >= 1, F.coalesce(F.try_element_at(labels, n), m)).otherwise(m)

    tail = F.zip_with(F.slice(gaps, F.lit(2), F.size(gaps)), found, lambda g, m: F.concat(fill(m), g))
    return F.concat(F.element_at(gaps, 1), F.array_join(tail, ""))
