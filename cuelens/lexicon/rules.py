"""Rules as data: patterns with an order, and conditions that become a Spark column or an SQL text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuelens.functions.dialect import literal, re2
from cuelens.functions.text import Marked, found_text, holds, matches, plain


@dataclass(frozen=True)
class Rule:
    """A named pattern; ``weight`` is in thousandths."""

    name: str
    pattern: str
    weight: int = 0
    label: str = ""


@dataclass(frozen=True)
class Has:
    pattern: str

    def column(self, text: Column | Marked) -> Column:
        return F.coalesce(holds(text, self.pattern), F.lit(False))

    def sql(self, text: str) -> str:
        return f"regexp_matches({text}, {literal(re2(self.pattern))})"


@dataclass(frozen=True)
class All:
    parts: tuple

    def column(self, text: Column | Marked) -> Column:
        out = F.lit(True)
        for p in self.parts:
            out = out & p.column(text)
        return out

    def sql(self, text: str) -> str:
        return "(" + " AND ".join(p.sql(text) for p in self.parts) + ")"


@dataclass(frozen=True)
class No:
    part: object

    def column(self, text: Column | Marked) -> Column:
        return ~self.part.column(text)

    def sql(self, text: str) -> str:
        return f"(NOT {self.part.sql(text)})"


@dataclass(frozen=True)
class NotAfter:
    """The first match of one pattern begins no later than that of the other; both must match."""

    first: str
    second: str

    def column(self, text: Column | Marked) -> Column:
        at = [F.instr(plain(text), found_text(plain(text), p)) for p in (self.first, self.second)]
        return Has(self.first).column(text) & Has(self.second).column(text) & (at[0] <= at[1])

    def sql(self, text: str) -> str:
        at = [f"strpos({text}, regexp_extract({text}, {literal(re2(p))}))" for p in (self.first, self.second)]
        return f"({Has(self.first).sql(text)} AND {Has(self.second).sql(text)} AND {at[0]} <= {at[1]})"


@dataclass(frozen=True)
class AtLeast:
    pattern: str
    n: int

    def column(self, text: Column | Marked) -> Column:
        return F.coalesce(F.size(matches(text, self.pattern)) >= self.n, F.lit(False))

    def sql(self, text: str) -> str:
        return f"(len(regexp_extract_all({text}, {literal(re2(self.pattern))})) >= {self.n})"


def patterns_of(test) -> list[str]:
    """All patterns that a condition looks for."""
    if isinstance(test, All):
        return [p for part in test.parts for p in patterns_of(part)]
    if isinstance(test, No):
        return patterns_of(test.part)
    return [test.first, test.second] if isinstance(test, NotAfter) else [test.pattern]


@dataclass(frozen=True)
class Signal:
    """Cases in order, the first that holds gives the status, else ``unclear``; weight in hundredths."""

    name: str
    category: str
    weight: int
    cases: tuple


@dataclass(frozen=True)
class Desk:
    name: str
    pattern: str
    kinds: tuple = ()


# Types of context cards, and what a type adds to a card's score in thousandths.
CARD_TYPES = ("institution", "lexicon", "history_frame", "intl_compare", "method")
CARD_BONUS = {"method": 500, "institution": 150, "history_frame": 100, "intl_compare": 100}


@dataclass(frozen=True)
class Pack:
    """Everything that a corpus' cues depend on."""

    name: str
    boilerplate: tuple[Rule, ...]
    detectors: tuple[Rule, ...]
    actionable: dict[str, str]
    support: tuple[str, ...]
    signals: tuple[Signal, ...]
    kinds: tuple[Rule, ...]
    drivers: tuple[tuple[str, int, object], ...]
    themes: tuple[Rule, ...]
    desks: tuple[Desk, ...]
    default_desk: str
    social: tuple[Rule, ...]
    classes: tuple[Rule, ...]
    nexus_direct: tuple[Rule, ...]
    nexus_possible: tuple[Rule, ...]
    gray: str
    #: Patterns on a nugget's English value that make it actionable too, and the kinds of fact that can explain a nugget.
    actionable_en: dict[str, str] = field(default_factory=dict)
    fact_kinds: dict[str, tuple[str, ...]] = field(default_factory=dict)
    #: English of terms, and what a nugget of a kind is called where none of its terms has one.
    glossary: dict[str, str] = field(default_factory=dict)
    cue_phrases: dict[str, str] = field(default_factory=dict)
    #: What two sources can share: named subjects, issuers, and stock wording that tells nothing.
    subjects: tuple[str, ...] = ()
    issuers: tuple[str, ...] = ()
    formula: tuple[str, ...] = ()
    instrument: str = ""
    meeting: str = ""
    extra: dict = field(default_factory=dict)


def triage_patterns(pack: Pack) -> list[str]:
    """Patterns of the scorecard, kinds, drivers, desks, themes, nexus and roles."""
    tests = [c for s in pack.signals for _, c in s.cases] + [t[0] for _, _, t in pack.drivers if not isinstance(t[0], str)]
    tests += [pack.extra["instrument_over_meeting"], pack.extra["defense"][1]]
    named = [r.pattern for rules in (pack.kinds, pack.themes, pack.desks, pack.nexus_direct, pack.nexus_possible) for r in rules]
    return [p for t in tests for p in patterns_of(t)] + named + [*pack.extra.get("roles", {}).values(), pack.instrument, pack.meeting]


def cut_patterns(pack: Pack) -> list[str]:
    """Patterns of nuggets, stock phrases, source classes and the gray zone."""
    return [r.pattern for rules in (pack.detectors, pack.boilerplate, pack.social, pack.classes) for r in rules] + [pack.gray]


def values_sql(rules: tuple[Rule, ...]) -> str:
    """Rules as the rows of an SQL VALUES list: ord, name, pattern, weight."""
    return ", ".join(f"({i}, {literal(r.name)}, {literal(re2(r.pattern))}, {r.weight})" for i, r in enumerate(rules))
