"""Domain profiles: how a text of a domain is read.

A profile says what a domain turns on as a few noun phrases; every sentence is made of those and of the text's own facts by
the forms below, which all profiles share. Which profile a text gets, how many scenarios it has, their horizons and what makes
one likelier are fixed.

A piece of text is a tuple of variants: the first whose ``{facts}`` the text all has is used. Facts are instrument, issued, deadline, amount,
vehicle, scope, ban, subject, subjects, strained (subjects whose finances are under strain), delegate, body; a variant
without any always holds.
"""

from __future__ import annotations

from dataclasses import dataclass

Piece = tuple[str, ...]


@dataclass(frozen=True)
class Scenario:
    """``likely`` lists facts that make it ``medium`` and not ``low``; ``("",)`` is always medium, ``("!",)`` always low, ``!fact`` holds without it."""

    label: Piece
    likely: tuple[str, ...]
    horizon: Piece
    basis: Piece
    trigger: str
    alternative: str = ""
    falsifier: str = ""


@dataclass(frozen=True)
class Profile:
    name: str
    label: str
    background: str
    so_what: tuple[Piece, ...]
    scenarios: tuple[Scenario, ...]
    watch: tuple[Piece, ...]
    questions: tuple[Piece, ...]
    themes: tuple[str, ...] = ()
    desks: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    pattern: str = ""


_MEDIUM, _LOW = ("",), ("!",)
#: Variants that are a name in angle brackets are the shared pieces of operators/analysis.py.
STAGE, FUNDING, CAPACITY = ("<stage>",), ("<funding>",), ("<capacity>",)


@dataclass(frozen=True)
class Domain:
    """What a domain turns on: the ``rule`` that acts in it, who ``applies`` it, whom it ``reaches``, a public ``measure`` of effect, and who may ``answer``."""

    rule: str
    applies: str
    reaches: str
    measure: str
    answer: str

    @property
    def background(self) -> str:
        return f"Read for four things: {self.rule}, {self.applies} who apply it, {self.reaches} whom it reaches, and {self.measure} by which anyone can check."

    def facts(self) -> Piece:
        return (
            f"Two checkable facts are on record, {{instrument}} and {{amount}}; from here on {self.applies} can be held to both.",
            f"One checkable fact is on record, {{amount}}; which {self.rule} it serves is not stated.",
            f"No fact of this excerpt alters {self.rule} by itself.",
        )

    def limits(self) -> Piece:
        return (f"Outside {{scope}} nothing changes for {self.reaches}.",)

    def forbids(self) -> Piece:
        return (f"For {self.reaches} the operative sentence is the prohibition, by which the text {{ban}}.",)

    def sides(self) -> Piece:
        return (f"An effect would show in {self.measure}, first at {self.reaches}.",)

    def named(self) -> Piece:
        return (f"Of all that {self.rule} covers, the excerpt singles out {{subjects}}.",)

    def strained(self) -> Piece:
        return (f"Support for {{strained}} shifts a loss that {self.reaches} would otherwise carry.", f"The excerpt does not say who carries a loss if {self.measure} disappoints.")

    def dated(self) -> Piece:
        return ("The time stated, {deadline}, gives the claim an end at which it is right or wrong.",)

    def rules(self, likely, horizon) -> Scenario:
        return Scenario(
            (f"Public by the time stated ({{deadline}}): a text that sets {self.rule}", f"Public: a text that sets {self.rule}"), likely, horizon,
            ("{Instrument} and {amount} are both announced, and neither works without terms (hypothesis).", "{Instrument} is announced, and does not work without terms (hypothesis).", "What is announced does not work without terms (hypothesis)."),
            f"A text signed by {self.applies} is published.", f"Terms stay internal to {self.applies} (hypothesis).", f"The time passes and {self.applies} have published no terms.",
        )

    def moves(self, likely, horizon) -> Scenario:
        return Scenario(
            (f"Change that others can count, in {self.measure}",), likely, horizon, (f"{self.reaches[0].upper()}{self.reaches[1:]} adjust to what they expect of {self.rule} (hypothesis).",),
            f"Two successive figures for {self.measure} point the same way.", f"{self.reaches[0].upper()}{self.reaches[1:]} wait for certainty (hypothesis).", f"Figures for {self.measure} stay within their usual range over the horizon.",
        )

    def answers(self, likely, horizon) -> Scenario:
        return Scenario(
            (f"An answer in public from {self.answer}",), likely, horizon, (f"What is done to {self.reaches} is visible to {self.answer} (hypothesis).",),
            f"A dated statement or filing by {self.answer}.", f"Silence of {self.answer} (hypothesis).", f"The horizon ends without a statement or filing by {self.answer}.",
        )

    def fades(self, likely, horizon) -> Scenario:
        return Scenario(
            (f"Nothing more on {self.rule}",), likely, horizon, (f"No duty binds {self.applies} to a next step (hypothesis).",),
            "Later texts repeat these sentences and add no fact.", f"A next step by {self.applies} (hypothesis).", "A later text adds an amount, a date or a document.",
        )

    def splits(self, likely, horizon) -> Scenario:
        return Scenario(
            (f"{self.measure[0].upper()}{self.measure[1:]} that differ from place to place",), likely, horizon, (f"Means of {self.applies} differ from place to place (hypothesis).",),
            f"Regional figures for {self.measure} drift apart.", "Means are evened out from above (hypothesis).", f"Regional figures for {self.measure} stay together.",
        )

    def watch(self) -> tuple[Piece, ...]:
        return (
            (f"{{Instrument}}: publication, number and issuer", f"Any numbered document on {self.rule}"), ("{amount}: tranche, payer and payee", "A first figure for money"),
            (f"Next figures for {self.measure}",), (f"Words and filings of {self.answer}",), ("State of affairs on {deadline}", f"Any date that {self.applies} accept"),
        )

    def questions(self) -> tuple[Piece, ...]:
        return (
            (f"Does {{instrument}} change {self.rule}, or restate it?", f"Is there a document behind {self.rule}?"), ("Is {amount} new money?", "Is any money involved?"),
            (f"Who among {self.reaches} lies inside {{scope}}?", f"Who among {self.reaches} is left out?"), (f"What would {self.applies} lose by doing nothing?",), (f"Since when is {self.measure} published, and by whom?",),
        )

    def profile(self, name: str, label: str, so_what: tuple[Piece, ...], scenarios: tuple[Scenario, ...], **match) -> Profile:
        return Profile(name, label, self.background, so_what, scenarios, self.watch(), self.questions(), **match)


_STRAIT = Domain("admission to cross-strait programmes", "offices that approve them", "organisers and visitors", "the list of approved programmes", "authorities across the strait")
_MINERALS = Domain("export licensing of processed minerals", "licensing offices", "refiners and their customers", "monthly export statistics", "governments of buying countries")
_CHIPS = Domain("eligibility for chip support", "fund managers", "chip plants and toolmakers", "published awards and output", "countries that control tools")
_MODELS = Domain("clearance of models for release", "registration offices", "model developers and data centres", "the register of cleared models", "suppliers of accelerators")
_CARS = Domain("support for batteries and charging", "ministries that pay it", "cell makers and charging operators", "registrations, exports and charging points", "trade authorities of importing countries")
_TRADE = Domain("treatment of named goods at the border", "customs and trade ministries", "shippers and importers", "customs clearances", "the other capital")
_FINANCE = Domain("a channel of public finance", "finance departments", "borrowers and local budgets", "issuance and completion figures", "bond markets")
_DEFENCE = Domain("industrial aims in public defence texts", "procurement offices", "suppliers", "budget lines and tender notices", "neighbouring governments")
_LOCAL = Domain("duties of counties and townships", "local offices", "residents and local staff", "staffing and service figures", "higher levels that assess them")
_ANY = Domain("a public commitment", "the bodies concerned", "those it concerns", "what they publish", "others concerned")

#: Finance policy by its words, beside its desk and kinds.
_FINANCE_KINDS = ("finance_risk", "macro_policy", "economic_data", "leadership_meeting", "five_year_plan", "dual_circulation")

PROFILES = (
    _STRAIT.profile("taiwan_strait", "Taiwan Strait", (_STRAIT.facts(), _STRAIT.limits(), _STRAIT.sides(), CAPACITY),
        (_STRAIT.rules(("amount",), ("{deadline}",)), _STRAIT.moves(_LOW, ("12-24 months",)), _STRAIT.fades(_MEDIUM, ("{deadline}",))), themes=("taiwan_strait",)),
    _MINERALS.profile("critical_minerals", "Critical minerals", (_MINERALS.forbids(), _MINERALS.facts(), _MINERALS.sides()),
        (_MINERALS.rules(("amount", "deadline"), ("{deadline}",)), _MINERALS.moves(_MEDIUM, ("6-24 months",)), _MINERALS.answers(_LOW, ("6-18 months",))), themes=("critical_minerals",)),
    _CHIPS.profile("semiconductors", "Semiconductors", (_CHIPS.facts(), _CHIPS.limits(), STAGE, _CHIPS.forbids()),
        (_CHIPS.rules(("amount", "deadline"), ("{deadline}",)), _CHIPS.moves(_MEDIUM, ("12-24 months",)), _CHIPS.answers(_MEDIUM, ("18-36 months",))), themes=("semiconductors",)),
    _MODELS.profile("china_ai", "China AI", (_MODELS.facts(), _MODELS.limits(), FUNDING, _MODELS.forbids(), _MODELS.sides()),
        (_MODELS.rules(("deadline",), ("{deadline}",)), _MODELS.splits(_MEDIUM, ("12 months",)), _MODELS.moves(_MEDIUM, ("12-24 months",))), themes=("china_ai",)),
    _CARS.profile("electric_vehicles", "Electric vehicles", (_CARS.facts(), _CARS.limits(), _CARS.forbids(), _CARS.sides(), STAGE),
        (_CARS.rules(("amount", "deadline"), ("{deadline}",)), _CARS.moves(_MEDIUM, ("12-18 months",)), _CARS.answers(_MEDIUM, ("6-18 months",))), themes=("electric_vehicles",)),
    _TRADE.profile("canada_trade", "Bilateral trade and diplomacy", (_TRADE.facts(), _TRADE.named(), _TRADE.sides(), _TRADE.dated()),
        (_TRADE.answers(_MEDIUM, ("3-12 months",)), _TRADE.moves(_LOW, ("6-18 months",)), _TRADE.fades(_MEDIUM, ("6-12 months",))), desks=("foreign_affairs",), kinds=("foreign_affairs",), pattern="中加|加方|加拿大"),
    _FINANCE.profile("macro_finance", "Economy and finance", (_FINANCE.facts(), _FINANCE.strained(), CAPACITY, STAGE),
        (_FINANCE.rules(("amount", "deadline"), ("{deadline}",)), _FINANCE.splits(_MEDIUM, ("6-18 months",)), _FINANCE.fades(("!instrument",), ("6-12 months",))),
        desks=("economy_investment",), kinds=_FINANCE_KINDS, pattern="地方债|隐性债务|房地产|保交楼|化债|财政政策|货币政策|扩大内需|稳增长|专项债"),
    _DEFENCE.profile("defense_public", "Defense — public policy discourse", (_DEFENCE.facts(), _DEFENCE.sides(), STAGE),
        (_DEFENCE.moves(_MEDIUM, ("{deadline}", "12-24 months")), _DEFENCE.answers(_LOW, ("6-18 months",)), _DEFENCE.fades(_MEDIUM, ("12 months",))), desks=("defense_public",), kinds=("defense_public",)),
    _LOCAL.profile("social_governance", "Social governance", (_LOCAL.facts(), _LOCAL.sides(), CAPACITY),
        (_LOCAL.rules(_MEDIUM, ("{deadline}", "6-18 months")), _LOCAL.splits(_MEDIUM, ("12 months",)), _LOCAL.answers(_LOW, ("12-24 months",))),
        desks=("social_governance",), kinds=("social_governance", "ideology_party", "rural_revitalization")),
)
GENERIC = _ANY.profile("general_policy", "Public policy", (STAGE, FUNDING, _ANY.limits(), _ANY.named(), CAPACITY, _ANY.forbids()),
    (_ANY.rules(("amount", "deadline"), ("{deadline}",)), _ANY.splits(_MEDIUM, ("12 months after {deadline}", "12 months")), _ANY.fades(("!body",), ("{deadline}",))))
