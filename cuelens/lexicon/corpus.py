"""The pack for general web corpora: cues that occur in texts of any language.

License lines play the named instrument, mail addresses the responsible body, phone numbers the
resource line, network addresses the named place, shouted words the ban, junk runs the shift.
"""

from __future__ import annotations

from cuelens.lexicon.rules import All, AtLeast, Desk, Has, No, NotAfter, Pack, Rule, Signal

_LICENSE = r"(Licensed|Released) under [A-Za-z0-9 ,.-]{2,40}|This work is licensed"
_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_PHONE = r"\+?\d[\d -]{7,}\d"
_ADDRESS = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
_JUNK, _SHOUT, _TABLE, _INSULT = r"[#*$%&]{3,}", "[A-Z]{3,}!!", r"[a-z]+ \| [a-z]+", "idiot|clown|moron|scum|loser|trash|stupid|pathetic|worthless|disgusting"
_EN, _FR, _DE, _ES = "(^| )(the|of|and)( |$)", "(^| )(les?|une?|du|et)( |$)", "(^| )(der|das|und|ein)( |$)", "(^| )(los|las|el|que)( |$)"

ACTIONABLE = {"named_instrument": "under|licensed", "resource_or_funding": r"\d", "numeric_target": r"\d{2,}", "timeline": r"\d{4}", "official_action": ""}

CORPUS = Pack(
    name="corpus",
    boilerplate=(Rule("license", _LICENSE), Rule("junk", _JUNK), Rule("shout", _SHOUT), Rule("table", _TABLE)),
    detectors=(
        Rule("numeric_target", r"\d+"),
        Rule("timeline", r"(19|20)\d\d"),
        Rule("named_instrument", _LICENSE),
        Rule("responsible_body", _MAIL),
        Rule("pilot_or_scope", _TABLE),
        Rule("constraint_or_ban", _SHOUT),
        Rule("resource_or_funding", _PHONE),
        Rule("named_sector_or_place", _ADDRESS),
        Rule("delta_or_priority_shift", _JUNK),
        Rule("official_action", _INSULT),
    ),
    actionable=ACTIONABLE,
    support=("responsible_body", "named_sector_or_place"),
    signals=(
        Signal("seq-the-before-and", "sequence", 8, (("hit", NotAfter(" the ", " and ")), ("miss", All((Has(" the "), Has(" and ")))), ("hit", Has(" the ")))),
        Signal("seq-two-lines", "sequence", 7, (("hit", AtLeast(r"\n", 2)), ("miss", No(Has(r"\n"))))),
        Signal("detail-license", "implementing_detail", 12, (("hit", Has(_LICENSE)), ("miss", No(Has(_LICENSE))))),
        Signal("detail-contact", "implementing_detail", 5, (("hit", Has(_MAIL)),)),
        Signal("press-shout", "press_placement", 9, (("hit", Has(_SHOUT)),)),
        Signal("conc-number", "concreteness", 6, (("hit", Has(r"\d")), ("miss", No(Has(r"\d"))))),
        Signal("tone-insult", "tone_framing", 4, (("hit", Has(_INSULT)),)),
        Signal("scope-table", "rollout_scope", 4, (("hit", Has(_TABLE)), ("miss", Has(_JUNK)))),
    ),
    kinds=(
        Rule("english", _EN, 1000),
        Rule("french", _FR, 950),
        Rule("german", _DE, 900),
        Rule("spanish", _ES, 850),
        Rule("contact", f"{_MAIL}|{_PHONE}", 840),
        Rule("licensed", _LICENSE, 820),
        Rule("noisy", f"{_JUNK}|{_SHOUT}", 720),
        Rule("tabular", _TABLE, 650),
    ),
    drivers=(
        ("english", 280, ("english",)),
        ("licensed", 140, ("licensed",)),
        ("other_language", 60, ("french", "german", "spanish")),
        ("contact", 80, (Has(_MAIL), ())),
        ("noisy_only", -100, (Has(_JUNK), ("english",))),
        ("numbers", 100, (Has(r"\d"), ())),
    ),
    themes=(Rule("insults", _INSULT), Rule("contacts", f"{_MAIL}|{_PHONE}|{_ADDRESS}"), Rule("tables", _TABLE)),
    desks=(
        Desk("hot_topics", f"{_INSULT}|{_MAIL}"),
        Desk("english_desk", _EN, ("english", "licensed")),
        Desk("romance_desk", f"{_FR}|{_ES}", ("french", "spanish")),
        Desk("german_desk", _DE, ("german",)),
        Desk("noise_desk", f"{_JUNK}|{_SHOUT}", ("noisy", "tabular")),
    ),
    default_desk="english_desk",
    social=(Rule("insult", _INSULT), Rule("shout", _SHOUT)),
    classes=(Rule("policy_instrument", _LICENSE), Rule("official_or_wire", _MAIL), Rule("press_commentary", _TABLE)),
    nexus_direct=(Rule("mail", _MAIL), Rule("address", _ADDRESS)),
    nexus_possible=(Rule("digits", r"\d{3,}"), Rule("junk", _JUNK)),
    gray=r"[#*$%&]{3,}",
    instrument=_LICENSE,
    meeting=r"\n",
    extra={"roles": {"defense_public": _JUNK, "diplomatic": _ADDRESS, "social_or_ideology": _INSULT}, "think_tank": _ADDRESS, "defense": ("noise_desk", Has(_JUNK)), "instrument_over_meeting": Has(_LICENSE)},
)
