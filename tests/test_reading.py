"""Gold cases, the gate, analysis, listings and the small operators a reader meets."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from cuelens.functions import gloss
from cuelens.lexicon import MANDARIN
from cuelens.lexicon.mandarin_facts import BANS, GLOSSARY, INSTRUMENTS, MANDARIN_FACTS
from cuelens.lexicon.policy import THEMES
from cuelens.operators import analysis, crossing, decisions, facts, gate, history, reading, scoring, substance
from cuelens.sources import feeds, records

#: Invented texts: zone, label, text, channel of the paste.
GOLD = [
    ("clear", "admit", "国务院办公厅要求,2026年底前出台配套规定,安排专项资金5000万元支持农业", "甲"),
    ("clear", "admit", "财政部印发通知，安排专项资金20亿元用于基层医疗设备更新，自2026年起实施。", "乙"),
    ("clear", "admit", "商务部公布实施细则，明确新能源汽车下乡补贴不超过3亿元，分三批拨付到位。", "丙"),
    ("clear", "admit", "农业农村部发布高标准农田建设管理办法，中央财政支持120亿元，覆盖京津冀地区。", "丁"),
    ("clear", "admit", "工业和信息化部启动大模型备案试点方案，安排专项资金6亿元支持人工智能企业。", "戊"),
    ("clear", "reject_thin", "会议强调，要坚持稳中求进，持续抓好各项工作，凝心聚力，砥砺前行，再创辉煌。", "己"),
    ("clear", "reject_thin", "要深入贯彻落实重要精神，提高政治站位，弘扬正能量，唱响主旋律，促进社会和谐稳定。", "庚"),
    ("clear", "reject_thin", "大家一致表示，要把思想和行动统一到会议精神上来，扎实推进高质量发展，不断开创新局面。", "辛"),
    ("clear", "reject_thin", "春天来了，公园里的花都开了，许多市民带着孩子出门游玩，享受温暖的阳光和清新的空气。", "壬"),
    ("clear", "social_downweight", "网传某机构将要调整政策，博主称消息未证实，请大家耐心等待进一步的公开信息发布。", "癸"),
    ("clear", "social_downweight", "微博上有人说当地即将出台新规，评论区意见不一，暂时没有看到任何权威来源的说法。", "子"),
    ("clear", "reject_thin", "干部群众纷纷表示要再接再厉，以更加饱满的热情投入到各项工作中去，不辜负期望和重托。", "丑"),
    ("clear", "social_downweight", "各方正在热议相关话题，希望有更多的公开材料可以参考，以便大家做出自己的判断和选择。", "微博转述"),
    ("gray", "defer", "外交部发言人就台湾有关问题回答了记者提问，重申一贯立场，没有提到任何新的文件安排。", "寅"),
    ("gray", "defer", "有关方面表示严禁炒作稀土价格，呼吁行业自律，维护市场秩序，共同营造良好的环境。", "卯"),
    ("gray", "defer", "专家认为，北极航道的前景值得关注，相关合作仍处于早期阶段，需要更多耐心和沟通。", "辰"),
    ("gray", "defer", "据介绍，相关工作将于2027年全面完成，届时将给群众的生活带来更多便利和实惠的体验。", "巳"),
    ("gray", "defer", "双方谈到CPTPP的前景，认为地区经济一体化符合各方利益，愿意继续保持接触和沟通交流。", "午"),
    ("gray", "reject_thin", "有观点认为，未来一段时间经济走势总体平稳，但仍需要保持耐心，积极应对各种风险挑战。", "未"),
    ("gray", "defer", "商务部与长三角的企业座谈，听取了大家对营商环境的看法，表示会认真研究这些建议内容。", "申"),
    ("gray", "defer", "业内人士关注北美市场的变化，认为软木贸易可能受到影响，但目前还没有看到具体的措施。", "酉"),
    ("gray", "reject_thin", "座谈会上大家畅所欲言，气氛热烈，与会人员表示收获很大，将把所学所思带回到工作岗位。", "戌"),
]


def screened(rows):
    rows = substance.cut(facts.facts(substance.normalise(rows)), MANDARIN)
    rows = rows.withColumn("source_class", scoring.source_class(F.col("text"), MANDARIN, label=F.col("source")))
    return decisions.intake(decisions.adoption(rows, MANDARIN), MANDARIN)


@pytest.fixture(scope="module")
def gold(spark):
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(GOLD)], "doc_id int, zone string, gold string, text string, source string")
    return {r.doc_id: r for r in screened(df).collect()}


def test_gold_accuracy(gold):
    right = {z: [g[1] == gold[i].intake for i, g in enumerate(GOLD) if g[0] == z] for z in ("clear", "gray")}
    wrong = [(g[2], g[1], gold[i].intake) for i, g in enumerate(GOLD) if gold[i].intake != g[1]]
    assert len(GOLD) == 22 and len(right["clear"]) == 13
    assert sum(right["clear"]) / 13 >= 0.85 and sum(right["gray"]) / 9 >= 0.8, wrong
    assert not [w for w in wrong if w[2] == "admit"]


def test_evidence_is_a_clause(gold):
    first = gold[0]
    assert (first.intake, first.n_strong >= 2) == ("admit", True)
    by_kind = {n.kind: n for n in first.nuggets}
    assert by_kind["timeline"].evidence == "2026年底前出台配套规定" and by_kind["resource_or_funding"].evidence == "安排专项资金5000万元支持农业"
    assert by_kind["resource_or_funding"].value_en == "special funds (RMB 50 million)"
    for r in gold.values():
        for n in r.nuggets:
            assert n.evidence in r.text and len(n.evidence) <= max(52, len(n.value))
        for f in r.facts:
            assert r.text[f.start : f.end] == f.value and f.quote in r.text and f.sentence in r.text


def test_label_counts_for_social_cues_only(spark):
    df = spark.createDataFrame([("没有线索的文字", "新华社"), ("没有线索的文字", "微博"), ("新华社电", "x")], "t string, l string")
    got = [r[0] for r in df.select(scoring.source_class(F.col("t"), MANDARIN, label=F.col("l"))).collect()]
    assert got == ["unknown_public", "social_commentary", "official_or_wire"]


FACT_CASES = [
    ("商务部发言人表示，有关部门不得擅自涨价。", [("actor", "商务部发言人", "the Ministry of Commerce spokesperson"), ("actor", "有关部门", "unnamed “relevant departments”"), ("prohibition", "不得擅自涨价", None)]),
    ("投资约12亿元，增长5.2%，不低于30万吨，信贷2万亿。", [("money", "约12亿元", "about RMB 1.2 billion"), ("quantity", "5.2%", "5.2%"), ("quantity", "不低于30万吨", "no less than 300000 tonnes"), ("money", "2万亿", "RMB 2 trillion in credit")]),
    ("企业获得5000元奖励和80万元补贴。", [("money", "80万元", "RMB 800,000 in subsidies")]),
    ("研究制定数据出境管理办法，坚决守住粮食安全底线。", [("instrument", "数据出境管理办法", "cross-border data transfer management measures"), ("prohibition", "坚决守住粮食安全底线", None)]),
    ("到2026年3月底前完成，十四五期间推进。", [("deadline", "到2026年3月底前", "by end-March 2026"), ("deadline", "十四五", "the 14th Five-Year Plan period (2021-2025)")]),
]


def test_facts_by_case(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FACT_CASES)], "doc_id int, text string")
    got = {r.doc_id: r for r in facts.facts(df).collect()}
    for i, (_, want) in enumerate(FACT_CASES):
        have = {(f.kind, f.value): f.value_en for f in got[i].facts}
        for kind, value, english in want:
            assert (kind, value) in have, (i, kind, value, have)
            assert english is None or have[kind, value] == english
    assert not any(f.value.endswith("5000元") for f in got[2].facts)
    assert [f.form for f in got[0].facts if f.kind == "actor"] == ["person", "unnamed"] and got[0].named_actor and got[1].funded


def test_gloss_and_catalogs(spark):
    row = spark.range(1).select(gloss.render(F.lit("新能源汽车的试点"), GLOSSARY).alias("a"), gloss.listed(F.array(F.lit("a"), F.lit(""), F.lit("b"), F.lit("a"), F.lit("c"))).alias("b"), gloss.with_article(F.lit("outline"), F.lit(False)).alias("c")).first()
    assert row.a.en == "new-energy vehicles pilot" and row.a.covered == 1.0 and row.b == "a, b and c" and row.c == "an outline"
    for table in map(list, (INSTRUMENTS, BANS, {**MANDARIN_FACTS.bodies, **MANDARIN_FACTS.meetings})):
        for a in table:  # one alternation claims as the fold does if of two terms that overlap in part the one that begins first also goes first
            assert not [b for b in table for k in range(1, min(len(a), len(b))) if table.index(a) > table.index(b) and a[-k:] == b[:k] and a not in b and b not in a]
    assert [r.id for r in reading.catalog(spark, analysis.profiles(), "id string, label string").orderBy("ord").collect()][-1] == "general_policy" and len(THEMES) == 8


def test_policy_overlay_and_role(spark):
    df = spark.createDataFrame([("根据加拿大投资法进行投资审查",), ("稀土出口",), ("天气",)], "text string")
    rows = scoring.policy_overlay(df, THEMES).withColumn("role", scoring.item_role(F.col("text"), F.lit("finance_risk"), MANDARIN)).collect()
    assert [r.policy_level for r in rows] == ["named_instrument", "topical", "none"] and rows[1].policy_hits[0].theme == "critical_minerals" and rows[2].role == "sector_or_risk"


BRIEF = {
    "source_digest": [{"point": "p", "quote": "原文", "source_label": "甲"}, {"point": "p", "quote": "编造", "source_label": "甲"}, {"point": "p", "quote": "别处", "source_label": "无"}],
    "briefing_en": {"what": "w", "so_what": "This will definitely happen", "confidence": "HIGH"},
    "adoption": {"adopted": False}, "desk_section": {"primary": "industrial_tech"}, "source_class": {"class": "social_commentary"},
    "corroboration": {"score": 3, "distinct_sources": 1}, "signaling_scorecard": {"rules": [{"id": "r", "weight": 2.0, "status": "odd"}], "tag": "fact"},
    "policy_outlook": {"scenarios": [{"label": "l", "likelihood": "sure"}]}, "ontology_lite": {"hits": [{"id": "c", "type": "spell", "tag": "x"}]},
}


def test_gate(spark):
    briefs = [(1, json.dumps(BRIEF)), (2, "{}"), (3, json.dumps({"briefing_en": {"what": "TOP SECRET and SIGINT"}, "info_triage": {"primary_kind": "macro_policy"}}))]
    df = spark.createDataFrame(briefs, "doc_id int, j string").select("doc_id", F.from_json("j", gate.BRIEFING).alias("b"), F.expr("array(named_struct('label', '甲', 'text', '这是原文。双循环'), named_struct('label', '乙', 'text', '别处'))").alias("sources"))
    rows = gate.findings(df)
    got = {}
    for r in rows.collect():
        got.setdefault(r.doc_id, {})[r.finding] = r.severity
    assert got[2] == {"triage-missing": "soft", "cross-source-limited-overlap": "soft"}
    assert {"ethics-secrecy-marking", "ethics-forbidden-framing"} <= set(got[3]) and "triage-missing" not in got[3]
    want = "quote-not-in-source quote-source-label-mismatch overclaim-forecast adoption-reject-confidence social-confidence-hard-cap corroboration-single-source-inflated scorecard-weight-range scorecard-status-invalid scorecard-tag-invalid outlook-likelihood-invalid outlook-missing-alternative outlook-missing-falsifier ontology-hit-tag-invalid ontology-hit-type-invalid"
    assert set(want.split()) <= set(got[1]) and "desk-primary-invalid" not in got[1]
    assert {r.doc_id: r.gate_passed for r in decisions.passed(df, rows).collect()} == {1: False, 2: True, 3: False}


def test_quality_value_and_review(spark):
    day = datetime.date(2026, 1, 1)
    rows = [(1, True, 2, (day, "wire", "day")), (2, True, 1, (None, "relative", "relative")), (3, False, 2, (day, "wire", "day")), (4, True, 2, (None, "none", "none"))]
    got = {r.doc_id: (r.quality, r.quality_missing) for r in decisions.brief_quality(spark.createDataFrame(rows, "doc_id int, adopted boolean, distinct_sources int, as_of struct<date:date,method:string,precision:string>")).collect()}
    assert got == {1: ("complete", []), 2: ("partial", ["second_public_source", "source_as_of"]), 3: ("rejected", ["actionable_hard_detail"]), 4: ("partial", ["source_as_of"])}
    value = spark.createDataFrame([("admit", True, "dense", 2), ("admit", True, "thin", 1), ("admit", True, "mixed", 0), ("defer", False, "dense", 3)], "i string, a boolean, b string, c int").select(decisions.info_value(F.col("i"), F.col("a"), F.col("b"), F.col("c")))
    assert [r[0] for r in value.collect()] == ["high", "low", "medium", "low"]
    kinds = "intake string, adopted boolean, substance_band string, corroboration int, quality_missing array<string>, missing_cues array<string>"
    cases = [("defer", False, "dense", 3, [], []), ("social_downweight", False, "thin", 0, [], []), ("reject_thin", False, "thin", 0, [], []), ("admit", True, "thin", 0, ["second_public_source", "source_as_of"], ["a", "b", "c"]), ("admit", True, "mixed", 1, [], ["a", "b", "c"]), ("admit", True, "dense", 2, [], None)]
    steps = [r.next_steps for r in decisions.next_steps(spark.createDataFrame(cases, kinds)).collect()]
    assert steps == [["wait_for_notice", "rerun_on_detail"], ["official_excerpt"], ["excerpt_with_detail", "more_than_direction"], ["second_excerpt", "dateline", "implementing_notice", "second_source"], ["implementing_notice", "a", "b"], ["verify"]]
    review = spark.createDataFrame([(True, "official_or_wire", True, "defer", "admit", True, True, "general_policy", False, None)], "class_ambiguous boolean, forced_class string, gray_open boolean, auto_intake string, intake string, intake_overridden boolean, adopted boolean, profile string, desk_guessed boolean, forced_profile string")
    assert [(p.id, p.status, p.resolved) for p in decisions.review_points(review).first().review] == [("source_class", "resolved", "official_or_wire"), ("intake_gray", "resolved", "admit"), ("domain_profile", "open", None)]
    scenarios = spark.sql("select array(named_struct('label', 'a', 'likelihood', 'low'), named_struct('label', 'b', 'likelihood', 'high'), named_struct('label', 'c', 'likelihood', 'high')) s")
    assert [(x.label, x.likelihood) for x in scenarios.select(decisions.clamp_scenarios(F.col("s"), F.lit("stale")).alias("s")).first().s] == [("b", "medium"), ("c", "medium"), ("a", "low")]


def test_profiles_differ_and_scenarios_are_whole(spark):
    text = "国务院办公厅印发通知，安排专项资金3亿元支持半导体试点，2026年底前完成，严禁骗补，增长5%。"
    names = [p for p, _ in analysis.profiles()]
    df = spark.createDataFrame([(i, text, n) for i, n in enumerate(names)] + [(99, "没有任何细节的一段普通文字，只是说说而已。", None)], "doc_id int, text string, forced string")
    rows = facts.facts(df).withColumns({"themes": F.array().cast("array<string>"), "desk": F.lit("none"), "primary_kind": F.lit("other_public_text")})
    got = {r.doc_id: r for r in analysis.analyse(analysis.pick(rows, "forced")).select("doc_id", "profile", "analysis").collect()}
    assert [got[i].profile for i in range(len(names))] == names and got[99].profile == "general_policy"
    for i in range(len(names)):
        a = got[i].analysis
        assert len(a.watchpoints) == 5 and len(a.questions) == 5 and a.so_what
        for s in a.scenarios:
            assert s.label and s.basis and s.alternative and s.falsifier
        assert len({s.alternative for s in a.scenarios}) == len(a.scenarios)
    assert len(got[99].analysis.scenarios) == 1 and max(len(got[i].analysis.scenarios) for i in range(len(names))) == 3


def test_enrichment_is_all_or_nothing(spark):
    base = "array(named_struct('alternative', 'o1', 'falsifier', 'f1'), named_struct('alternative', 'o2', 'falsifier', 'f2'))"
    kinds = "array<struct<index:int,alternative:string,falsifier:string>>"
    cases = ['[{"index":1,"alternative":"b","falsifier":"y"},{"index":0,"alternative":"a","falsifier":"x"}]', '[{"alternative":"a","falsifier":"x"},{"alternative":"a","falsifier":"y"}]', '[{"alternative":"a","falsifier":"x"}]', '[{"alternative":"a","falsifier":""},{"alternative":"b","falsifier":"y"}]']
    df = spark.createDataFrame([(c,) for c in cases], "j string").select(analysis.enriched(F.expr(base), F.from_json("j", kinds)).alias("s"))
    assert [[x.alternative for x in r.s] for r in df.collect()] == [["a", "b"]] + [["o1", "o2"]] * 3


def test_texts_for_readers(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    assert tuple(one(reading.highlighted(F.lit("前面引文后面"), F.lit("引文")))) == ("前面", "引文", "后面") and one(reading.highlighted(F.lit("a"), F.lit("b"))) is None
    assert one(reading.judgments(F.lit("One is so. Two, e.g. this. “Three” holds."))) == ["One is so.", "Two, e.g. this.", "“Three” holds."]
    lead = one(reading.research_lead(F.lit("What follows? [search: rare earth quota]")))
    assert tuple(lead) == ("What follows?", "rare earth quota", "https://www.google.com/search?q=rare%20earth%20quota") and one(reading.research_lead(F.lit("plain"))).query is None
    assert [one(reading.first_object(F.lit(t))) for t in ('x ```json\n{"a":1}\n``` y', 'so {"a":{"b":2}} end', '{"c":3}', "")] == ['{"a":1}', '{"a":{"b":2}}', '{"c":3}', "{}"]
    queries = one(reading.search_queries(F.lit("中新社北京1月2日电 (记者 某某) 会见外宾"), F.lit("管理办法"), F.expr("array(named_struct('kind', 'official_action', 'evidence', '会见外宾'))")))
    assert queries == ["会见外宾 管理办法", "会见外宾 管理办法 " + reading.CRITICAL, "会见外宾 管理办法 历年 同类 回应 对比"]
    assert [one(reading.safe_name(F.lit(n))) for n in ("a.json", "../a", "..", "a/b", "a\n")] == ["a.json", None, None, None, None]
    assert one(crossing.anchors(F.lit("增长 5 % 到2026 年底，《办法二号》，5%"))) == ["5%", "2026年底", "《办法二号》"]
    digest = one(reading.with_urls(F.expr("array(named_struct('point', 'p', 'source_label', 'b'))"), F.expr("array(named_struct('label', 'b', 'url', 'u1'), named_struct('label', 'b', 'url', 'u2'))")))
    assert digest[0].source_url == "u1"
    notes = substance.empty_calories(F.lit("强调推动高质量发展，弘扬主旋律"), F.array().cast(f"array<{substance.NUGGET}>"), MANDARIN)
    assert one(notes) == ["verbs_without_instrument", "slogans_without_numbers", "mobilisation_without_policy", "no_detail"]
    keys = crossing.topic_keys(F.lit("d"), F.array(F.lit("h")), F.lit("k"), F.array(F.lit("s")), F.expr("array(named_struct('kind', 'named_instrument', 'value', '办法', 'value_en', 'Measures'), named_struct('kind', 'timeline', 'value', 'x', 'value_en', 'y'))"))
    assert one(keys) == ["desk:d", "hot:h", "kind:k", "subj:s", "nugget:measures"]


def test_requests_become_sources(spark):
    long = "x" * 25
    kind = "run int, sources array<struct<label:string,text:string,url:string,channelTier:string>>, sourceText string, sourceLabel string, sourceUrl string, sourceChannelTier string"
    rows = [(1, [(None, f" {long} ", None, "central_wire"), ("b", "short", None, None), ("c", long, " u ", "odd")], long, None, None, None), (2, [], long, None, "u", "commercial"), (3, None, "tiny", None, None, None)]
    df = spark.createDataFrame(rows, kind)
    got = [tuple(r) for r in substance.sources(df).orderBy("run", "src").collect()]
    assert got == [(1, 0, "source", long, None, "central_wire"), (1, 1, "c", long, "u", None), (2, 0, "paste-1", long, "u", "commercial")]
    assert [r.run for r in substance.within_limit(df, 60).collect()] == [2, 3]


def test_runs_are_compared(spark):
    rows = spark.createDataFrame([(1, 0, "central_wire", "双循环 a"), (1, 1, "commercial", "双循环 b"), (1, 2, None, "x"), (2, 0, "commercial", "稳增长"), (2, 1, "commercial", "y"), (3, 0, "commercial", "稳增长")], "run int, src int, channel string, text string")
    assert {r.run: (r.tiers, r.cross_tier) for r in crossing.tier_spread(rows, "run", "src").collect()} == {1: (["central_wire", "commercial"], True), 2: (["commercial"], False)}
    assert {r.run: r.weakest for r in crossing.weakest_tier(rows, "run", "src").collect()} == {1: "commercial", 2: "commercial", 3: "commercial"}
    assert [r.run for r in crossing.limited_overlap(rows, "run", "text", gate.SHARED_TERMS, "src").collect()] == [2]


RECORD = "id string, subscription_id string, created_at string, provenance string, adopted boolean, drivers array<string>, desk string, grade string, nexus string, primary_kind string, corroboration int, what string"
RECORDS = [
    ("a", "s", "2026-01-01", "live", True, [], "defense_public", "P2", "none", "k", 2, "w"), ("b", "s", "2026-01-02", "live", None, None, "hot_topics", "P1", "direct", "k", 0, "w"),
    ("c", "s", "2026-01-03", "fixture_demo", True, [], "hot_topics", "P3", "none", "k", 3, "w"), ("d", "s", "2026-01-04", "live", False, [], "hot_topics", None, "none", "k", 1, "w"),
    ("e", "s", "2026-01-05", "live", True, [reading.SUBNATIONAL], "hot_topics", "P1", "possible", "k", 1, "w"), ("f", "s", "2026-01-06", None, True, [], "odd", "P1", "possible", "k", 1, "w"),
]


def test_listings(spark):
    df = spark.createDataFrame(RECORDS, RECORD)
    ids = lambda x: [r.id for r in x.collect()]
    assert ids(reading.visible(df).orderBy(*reading.listing_order())) == ["b", "f", "a"]
    assert ids(reading.visible(df, True, True, True, "hot_topics").orderBy(*reading.listing_order(by_grade=True))) == ["e", "b", "c", "d"]
    assert ids(reading.reader_feed(df, "hot_topics")) == ["e", "d", "c", "b"]
    assert {r.desk: r.n for r in reading.desk_counts(df).collect()} == {"hot_topics": 4, "defense_public": 1, "odd": 1}
    assert [(r.desk, r.ids) for r in reading.by_desk(df).collect()] == [("hot_topics", ["b", "c", "d", "e"]), ("defense_public", ["a"]), ("odd", ["f"])]
    board = reading.portfolio(df, 2).collect()
    assert [(r.desk, r.n_items, r.max_band, len(r["items"])) for r in board] == [("hot_topics", 4, "strong", 2), ("defense_public", 1, "moderate", 1), ("odd", 1, "weak", 1)]
    more = df.withColumns({"source": F.struct(F.lit("L").alias("label")), "gate_passed": F.lit(True), "headline": F.lit("h"), "quality": F.lit("partial"), "confidence": F.lit("low"), "credibility": F.lit("low"), "intake": F.lit("defer"), "json_path": F.lit("/x/y.json"), "markdown_path": F.lit("z.md")})
    row = reading.list_rows(more).first()
    assert (row.json_url, row.markdown_url, row.deferred) == ("/outbox/briefs/y.json", "/outbox/briefs/z.md", True) and json.loads(reading.summary(more).first().payload)["source_label"] == "L"


def test_pairs_rise(spark):
    items = spark.createDataFrame([("s", "a", 0, True, True, "x"), ("s", "b", 1, True, False, "x"), ("s", "c", 2, False, True, "x"), ("t", "d", 0, True, True, "x")], "section string, id string, ord int, meeting boolean, instrument boolean, role string")
    found = reading.pairs(items)
    assert [tuple(r) for r in found.collect()] == [("s", "b", "a")]
    gain = reading.pair_gain(found, spark.createDataFrame([("a", 1), ("b", 0)], "id string, score int"), spark.createDataFrame([("s", 3)], "section string, score int")).first()
    assert (gain.before_max, gain.before_min, gain.rose, gain.reinforced) == (1, 0, True, True)
    hits = spark.createDataFrame([(1, 0, 0, "u"), (1, 1, 0, "u"), (1, 1, 1, "v")], "run int, angle int, pos int, url string")
    assert sorted((r.angle, r.url) for r in reading.one_of_each_url(hits, "run").collect()) == [(0, "u"), (1, "v")]


def test_silence_needs_thin_and_an_earlier_time(spark):
    rows = [(1, "2026-01-01", "dense"), (2, "2026-01-20", "thin"), (3, "2026-01-20", "thin"), (4, "2026-02-20", "dense")]
    df = spark.createDataFrame([("s", i, datetime.datetime.fromisoformat(t), b) for i, t, b in rows], "subject string, event_id int, ts timestamp, band string")
    got = {r.event_id: (r.prior_count, r.gap_days, r.silent) for r in history.silence(df, ["subject"], "ts", band="band").collect()}
    assert got == {1: (0, None, False), 2: (1, 19, True), 3: (1, 19, True), 4: (3, 31, False)}


def test_fixtures_pages_and_briefs(spark, tmp_path):
    long = "足够长的一段测试文字，用来检查读取。" * 2
    for name, body in (("b", {"domain": "d", "sourceLabel": "L", "sourceText": long}), ("a", {"sourceText": long}), ("c", {"sourceText": "short"})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    assert [(r.id, r.domain, r.label) for r in feeds.read_fixtures(spark, str(tmp_path)).collect()] == [("a", "unknown", "a.json"), ("b", "d", "L")]
    white = spark.createDataFrame([("w", "local_json", "x/b.json"), ("v", "rss", None)], "id string, type string, path string")
    assert [(r.source_id, r.text) for r in feeds.local_rows(spark, white, str(tmp_path)).collect()] == [("w", long)]
    pages = spark.createDataFrame([(1, "u", "<p>" + long + "</p>", "text/html; charset=utf-8"), (2, "u", "<p>" + long, "text/plain"), (3, "u", long, "image/png")], "page_id int, url string, html string, content_type string")
    assert {r.page_id: r.text[:3] for r in feeds.page_rows(pages).collect()} == {1: long[:3], 2: "<p>"}
    xml = spark.createDataFrame([("s", "<item><title>T</title><description>D</description></item><item><title>U</title></item>")], "source_id string, xml string")
    assert [(r.item_pos, r.text) for r in feeds.rss_rows(xml).collect()] == [(0, "T\nD"), (1, "U")]
    rows = spark.createDataFrame([("1", "s", None, None, "# one\ntwo")], "id string, subscription_id string, url string, provenance string, markdown string")
    records.write_briefs(rows, str(tmp_path / "o"), live=True)
    assert records.read_json_records(spark, str(tmp_path / "o/json"), "id string, url string, provenance string").first().provenance == "live"
    records.append_audit(rows.select("id", F.col("markdown").alias("text")), str(tmp_path / "audit"))
    audit = spark.read.json(str(tmp_path / "audit")).first()
    assert len(audit.source_hash) == 16 and "text" not in audit.asDict()
    records.one_archive(rows.withColumn("provenance", F.lit("live")), str(tmp_path / "arc"))
    assert spark.read.json(str(tmp_path / "arc")).count() == 1
    made = spark.range(1).select(records.record_id(F.lit("2026-01-02").cast("date"), F.lit("Sub x"), F.lit("源"), F.lit("t")).alias("i")).first().i
    assert made.startswith("20260102_sub-x_-_") and len(made.split("_")[-1]) == 8
    cards = spark.createDataFrame([("b", "B"), ("a", "A")], "name string, body string")
    assert reading.prompt(cards).first().prompt == "### a\nA\n\n### b\nB"
