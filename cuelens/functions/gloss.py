"""English for terms of a glossary: longest term first from left to right, as column builders."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuelens.functions.text import bind


def any_of(terms) -> str:
    """A pattern of all terms, the longest first, earlier ones first among equals."""
    return "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))


def looked_up(table: dict[str, str], term: Column) -> Column:
    """A term's value, as text, or null. The table is one literal of the plan, whatever its size."""
    text = "\x02".join(f"{k}\x01{v}" for k, v in table.items())
    return F.try_element_at(F.str_to_map(F.lit(text), F.lit("\x02"), F.lit("\x01")), term)


def render(phrase: Column, glossary: dict[str, str]) -> Column:
    """struct<en,covered>: the terms' English in order, and the share of characters that have a term; others are skipped."""

    def made(found: Column) -> Column:
        english = F.filter(F.transform(found, lambda t: looked_up(glossary, t)), lambda e: e != "")
        size = F.aggregate(found, F.lit(0), lambda a, t: a + F.length(t))
        return F.struct(F.array_join(english, " ").alias("en"), F.when(F.length(phrase) > 0, size / F.length(phrase)).otherwise(0.0).alias("covered"))

    return F.get(F.transform(F.array(F.regexp_extract_all(phrase, F.lit(any_of(glossary)), F.lit(0))), made), F.lit(0))


def first_of_catalog(text: Column, table: dict[str, str]) -> Column:
    """English of the first term in the table's order that occurs anywhere in the text, or null."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(k)), F.lit(v)) for k, v in table.items()])


def without_article(english: Column) -> Column:
    return F.regexp_replace(english, r"(?i)^(a|an|the)\s+", "")


def with_article(english: Column, plural: Column) -> Column:
    article = lambda e: F.when(e.rlike("(?i)^[aeiou]"), F.lit("an ")).otherwise(F.lit("a "))
    return bind(english, lambda e: F.when(plural, without_article(e)).when(e.rlike(r"(?i)^(a|an|the)\s"), e).otherwise(F.concat(article(e), e)))


def capital(english: Column) -> Column:
    return bind(english, lambda e: F.concat(F.upper(F.left(e, F.lit(1))), F.substring(e, F.lit(2), F.length(e))))


def listed(items: Column) -> Column:
    """Distinct items as ``a``, ``a and b``, ``a, b and c``; empty ones do not count."""

    def made(u: Column) -> Column:
        head = F.array_join(F.slice(u, F.lit(1), F.size(u) - 1), ", ")
        return F.when(F.size(u) == 0, F.lit("")).when(F.size(u) == 1, F.get(u, F.lit(0))).otherwise(F.concat(head, F.lit(" and "), F.try_element_at(u, F.lit(-1))))

    return F.get(F.transform(F.array(F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))), made), F.lit(0))
