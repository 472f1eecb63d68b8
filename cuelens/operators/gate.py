"""The claim gate: what a drafted briefing must not say or leave out, as rules over its record.

A record is a nested briefing ``b`` (``BRIEFING``; any part may be missing) with its ``sources``. Each rule gives at most
one finding, or one an element of a list; a missing part is no offence unless a rule says so. Hard findings stop it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelens.functions.dialect import java
from cuelens.lexicon.rules import CARD_TYPES

_TAGGED = "tag:string,framing:string"
BRIEFING = (
    "struct<source_digest:array<struct<point:string,quote:string,source_label:string>>,context_notes:array<struct<card:string,note:string,tag:string>>,"
    "briefing_en:struct<what:string,so_what:string,confidence:string>,"
    "signaling_valves:struct<sequence:struct<observation:string,reading:string,tag:string>,implementing_detail:struct<observation:string,reading:string,tag:string>,press_placement:struct<observation:string,reading:string,tag:string>,calibration:string>,"
    f"canada_nexus:struct<level:string,{_TAGGED}>,substance_cut:struct<band:string,{_TAGGED}>,desk_section:struct<primary:string,{_TAGGED}>,content_analysis:struct<so_what:string,{_TAGGED}>,"
    f"adoption:struct<adopted:boolean,framing:string>,ontology_lite:struct<hits:array<struct<id:string,type:string,tag:string>>,{_TAGGED}>,source_class:struct<class:string,framing:string>,"
    f"analysis_confidence:struct<level:string,tag:string>,source_credibility:struct<level:string,tag:string,source_tier:struct<tier:string,{_TAGGED}>>,"
    "corroboration:struct<score:int,distinct_sources:int>,canada_policy_link:struct<level:string,framing:string>,"
    "info_triage:struct<kinds:array<struct<kind:string>>,primary_kind:string,tag:string,importance:struct<grade:string,tag:string>>,"
    "signaling_scorecard:struct<rules:array<struct<id:string,weight:double,status:string>>,tag:string,calibration:string>,"
    "policy_outlook:struct<scenarios:array<struct<label:string,likelihood:string,basis:string,alternative:string,falsifier:string,tag:string>>>,brief_quality:struct<level:string>>"
)
_FOUND = "struct<finding:string,severity:string,evidence:string>"

# Wording that no output may have, and wording that claims too much.
FORBIDDEN = (r"(?i)\bSIGINT\b", r"\bCSE\b", r"\bCSIS\b", "(?i)espionage", r"(?i)spy\s*tool", r"(?i)classified\s+access", "(?i)wiretap")
SECRECY = (r"(?i)\bTOP\s*SECRET\b", r"(?i)\bTS\/SCI\b", r"(?i)\bCODAR\b", r"密级\s*[:：]?\s*(绝密|机密|秘密)", r"(?i)\b(classification|clearance)\s*[:=]\s*(top\s*secret|secret|confidential)\b")
OVERCLAIM = r"(?i)\b(will definitely|guaranteed to|secretly plans|must happen|inevitable that)\b"
KINDS = (
    "macro_policy", "implementing_instrument", "industrial_tech_policy", "foreign_affairs", "defense_public", "finance_risk", "rural_revitalization", "ideology_party", "dual_circulation",
    "five_year_plan", "social_governance", "economic_data", "press_commentary", "leadership_meeting", "local_policy", "other_public_text",
)
SHARED_TERMS = ("高质量发展", "新质生产力", "稳增长", "一带一路", "粮食安全", "金融风险", "双循环", "乡村振兴")
_LEVELS = ("low", "medium", "high")
# Id, place, and what may stand there. The desks are those of the catalog.
ONE_OF = (
    ("confidence-invalid", "briefing_en.confidence", _LEVELS), ("canada-nexus-tag-invalid", "canada_nexus.tag", ("hypothesis",)),
    ("canada-nexus-framing-invalid", "canada_nexus.framing", ("civilian-reader-interest-flag",)), ("canada-nexus-level-invalid", "canada_nexus.level", ("none", "possible", "direct")),
    ("substance-tag-invalid", "substance_cut.tag", ("hypothesis",)), ("substance-framing-invalid", "substance_cut.framing", ("civilian-boilerplate-vs-substance",)),
    ("substance-band-invalid", "substance_cut.band", ("thin", "mixed", "dense")), ("desk-tag-invalid", "desk_section.tag", ("hypothesis",)),
    ("desk-framing-invalid", "desk_section.framing", ("civilian-briefing-desk-section",)),
    ("desk-primary-invalid", "desk_section.primary", ("hot_topics", "economy_investment", "industrial_tech", "foreign_affairs", "defense_public", "social_governance")),
    ("content-analysis-framing-invalid", "content_analysis.framing", ("civilian-content-analysis",)), ("content-analysis-tag-invalid", "content_analysis.tag", ("hypothesis",)),
    ("adoption-framing-invalid", "adoption.framing", ("civilian-detail-adoption",)), ("ontology-framing-invalid", "ontology_lite.framing", ("civilian-ontology-lite",)),
    ("ontology-tag-invalid", "ontology_lite.tag", ("hypothesis",)), ("source-class-framing-invalid", "source_class.framing", ("civilian-source-class",)),
    ("confidence-tag-invalid", "analysis_confidence.tag", ("hypothesis",)), ("confidence-level-invalid", "analysis_confidence.level", _LEVELS),
    ("source-credibility-tag-invalid", "source_credibility.tag", ("hypothesis",)), ("source-credibility-level-invalid", "source_credibility.level", _LEVELS),
    ("source-tier-framing-invalid", "source_credibility.source_tier.framing", ("civilian-curated-source-tier",)), ("source-tier-tag-invalid", "source_credibility.source_tier.tag", ("hypothesis",)),
    ("canada-policy-framing-invalid", "canada_policy_link.framing", ("civilian-canada-public-policy-overlay",)),
    ("canada-policy-level-invalid", "canada_policy_link.level", ("none", "topical", "named_instrument")), ("triage-tag-invalid", "info_triage.tag", ("hypothesis",)),
    ("triage-primary-invalid", "info_triage.primary_kind", KINDS), ("triage-grade-invalid", "info_triage.importance.grade", ("P1", "P2", "P3", "P4")),
    ("triage-importance-tag-invalid", "info_triage.importance.tag", ("hypothesis",)), ("scorecard-tag-invalid", "signaling_scorecard.tag", ("hypothesis",)),
    ("brief-quality-invalid", "brief_quality.level", ("complete", "partial", "rejected")),
)
#: Places whose value counts in lower case.
FOLDED = ("tag", "confidence")
OVERCLAIMING = (
    ("overclaim-forecast", "briefing_en.so_what"), ("content-analysis-overclaim", "content_analysis.so_what"), ("valve-calibration-overclaim", "signaling_valves.calibration"),
    ("scorecard-overclaim", "signaling_scorecard.calibration"),
)
VALVES = ("sequence", "implementing_detail", "press_placement")


def _finding(test: Column, name: str, evidence: Column, severity: str = "soft") -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(name).alias("finding"), F.lit(severity).alias("severity"), evidence.cast("string").alias("evidence")))


def _each(items: Column, rules) -> Column:
    """Findings of every element of a list."""
    return F.flatten(F.transform(items, lambda x: F.array_compact(F.array(*rules(x)))))


def _not_in(value: Column, allowed: tuple[str, ...]) -> Column:
    return (value != "") & ~value.isin(*allowed)


def _quotes(b: Column) -> Column:
    """Quotes must stand in a source: in that of their label, or in any if no source has it, which is told."""

    def rules(row: Column) -> list[Column]:
        quote, label = F.trim(row["quote"]), F.trim(F.coalesce(row["source_label"], F.lit("")))
        own = F.filter("sources", lambda s: s["label"] == label)
        astray = (label != "") & (F.size(own) == 0)
        pool = F.when((label != "") & (F.size(own) > 0), own).otherwise(F.col("sources"))
        held = F.exists(pool, lambda s: F.contains(s["text"], quote))
        return [_finding((quote != "") & ~held, "quote-not-in-source", F.left(quote, F.lit(80)), "hard"), _finding((quote != "") & held & astray & (F.size("sources") > 0), "quote-source-label-mismatch", F.left(quote, F.lit(80)))]

    return _each(b["source_digest"], rules)


def findings(briefs: DataFrame) -> DataFrame:
    """(doc_id, finding, severity, evidence) of briefs (doc_id, b, sources array<struct<label,text>>)."""
    b = F.col("b")

    def at(path: str) -> Column:
        return F.col("b." + path)

    blob = F.to_json("b")
    parts = []
    for patterns, name in ((FORBIDDEN, "ethics-forbidden-framing"), (SECRECY, "ethics-secrecy-marking")):
        parts += [F.array(_finding(blob.rlike(java(p)), name, F.regexp_extract(blob, java(p), 0), "hard")) for p in patterns]
    parts.append(_quotes(b))
    holding = lambda t: F.size(F.filter("sources", lambda s: F.contains(s["text"], F.lit(t))))
    present = [holding(t) for t in SHARED_TERMS]
    most = F.greatest(*present)
    parts.append(F.array(_finding((F.size("sources") >= 2) & (most == 1), "cross-source-limited-overlap", F.array_join(F.transform("sources", lambda s: s["label"]), " + "))))
    parts.append(_each(at("context_notes"), lambda n: [_finding(_not_in(F.lower(n["tag"]), ("background", "hypothesis")), "context-tag-invalid", F.lower(n["tag"]))]))
    for name, path, allowed in ONE_OF:
        value = F.lower(at(path)) if path.split(".")[-1] in FOLDED else at(path)
        parts.append(F.array(_finding(_not_in(value, allowed), name, at(path))))
    for name, path in OVERCLAIMING:
        parts.append(F.array(_finding(at(path).rlike(java(OVERCLAIM)), name, F.left(at(path), F.lit(120)))))
    for v in VALVES:
        tag, reading, seen = (at(f"signaling_valves.{v}.{x}") for x in ("tag", "reading", "observation"))
        parts.append(F.array(_finding(_not_in(F.lower(tag), ("hypothesis", "background")), "valve-tag-invalid", F.lower(tag))))
        both = F.coalesce(reading.rlike(java(OVERCLAIM)), F.lit(False)) | F.coalesce(seen.rlike(java(OVERCLAIM)), F.lit(False))
        parts.append(F.array(_finding(both, "valve-overclaim", F.left(F.coalesce(F.nullif(reading, F.lit("")), seen), F.lit(120)))))
    sure = F.lower(at("briefing_en.confidence")) == "high"
    level, tier, kind = F.lower(at("source_credibility.level")), at("source_credibility.source_tier.tier"), at("source_class.class")
    parts.append(
        F.array(
            _finding(~at("adoption.adopted") & sure, "adoption-reject-confidence", F.lit("confidence=high")),
            _finding((kind == "social_commentary") & sure, "social-confidence-hard-cap", F.lit("confidence=high")),
            _finding((kind == "social_commentary") & (level == "high"), "social-source-credibility-cap", level),
            _finding((tier == "D") & (level == "high"), "source-tier-d-cap", level),
            _finding(tier.isin("C", "U") & (level == "high"), "source-tier-cu-cap", F.concat(tier, F.lit(":"), level)),
            _finding(~at("corroboration.score").between(0, 3), "corroboration-range-invalid", at("corroboration.score")),
            _finding((at("corroboration.score") >= 2) & (F.coalesce(at("corroboration.distinct_sources"), F.lit(0)) < 2), "corroboration-single-source-inflated", F.concat(F.lit("score="), at("corroboration.score").cast("string"))),
            _finding(at("info_triage").isNull(), "triage-missing", F.lit("info_triage")),
            _finding(at("signaling_scorecard").isNotNull() & (F.coalesce(F.size(at("signaling_scorecard.rules")), F.lit(0)) <= 0), "scorecard-empty", F.lit("rules=[]")),
        )
    )
    named = lambda x, v: F.concat(F.coalesce(x["id"], F.lit("?")), F.lit(":"), v.cast("string"))
    parts.append(_each(at("ontology_lite.hits"), lambda h: [_finding(_not_in(F.lower(h["tag"]), ("background", "hypothesis")), "ontology-hit-tag-invalid", named(h, h["tag"])), _finding(_not_in(h["type"], CARD_TYPES), "ontology-hit-type-invalid", named(h, h["type"]))]))
    parts.append(_each(at("info_triage.kinds"), lambda k: [_finding(_not_in(k["kind"], KINDS), "triage-kind-invalid", k["kind"])]))
    parts.append(_each(at("signaling_scorecard.rules"), lambda r: [_finding(~r["weight"].between(0, 1), "scorecard-weight-range", named(r, r["weight"])), _finding(_not_in(F.lower(r["status"]), ("hit", "miss", "unclear")), "scorecard-status-invalid", named(r, r["status"]))]))

    def outlook(s: Column) -> list[Column]:
        said = F.coalesce(s["basis"].rlike(java(OVERCLAIM)), F.lit(False)) | F.coalesce(s["label"].rlike(java(OVERCLAIM)), F.lit(False))
        lacks = lambda x: (s["label"] != "") & (F.coalesce(x, F.lit("")) == "")
        return [
            _finding(_not_in(F.lower(s["tag"]), ("hypothesis",)), "outlook-tag-invalid", F.lower(s["tag"])), _finding(_not_in(F.lower(s["likelihood"]), _LEVELS), "outlook-likelihood-invalid", F.lower(s["likelihood"])),
            _finding(said, "outlook-overclaim", F.left(F.coalesce(F.nullif(s["label"], F.lit("")), s["basis"]), F.lit(120))),
            _finding(lacks(s["alternative"]), "outlook-missing-alternative", F.left(s["label"], F.lit(80))), _finding(lacks(s["falsifier"]), "outlook-missing-falsifier", F.left(s["label"], F.lit(80))),
        ]

    parts.append(_each(at("policy_outlook.scenarios"), outlook))
    none = F.array().cast(f"array<{_FOUND}>")
    every = F.concat(*[F.coalesce(F.array_compact(p), none) for p in parts])
    return briefs.select("doc_id", F.explode(every).alias("f")).select("doc_id", "f.finding", "f.severity", "f.evidence")
