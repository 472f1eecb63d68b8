"""Mandarin goldens, properties, and sources."""

import json

from pyspark.sql import functions as F

from cuelens.lexicon import MANDARIN
from cuelens.operators import crossing, decisions, scoring, substance
from cuelens.plans.briefing import brief
from cuelens.sources import feeds, records

#: Invented texts.
ROWS = [
    (1, "样例甲", "商务部印发通知，安排专项资金3.5亿元支持半导体试点，2026年底前完成，严禁挪用资金。", None),
    (2, "样例乙", "会议强调，要坚持稳中求进，推动高质量发展，抓好各项工作落实，凝心聚力再创辉煌。", None),
    (3, "微博转述", "网传某地将出台新的补贴政策，博主称消息未证实，请大家耐心等待正式的消息。", None),
    (4, "样例丁", "国务院办公厅发布稀土管理条例，工业和信息化部负责，一律不得超额开采，自2026年3月起施行。", None),
    (5, "样例戊", "加拿大与中方代表会晤，双方就菜籽贸易交换了意见，强调建设性对话的重要性。", None),
]


def sample(spark):
    return spark.createDataFrame(ROWS, "doc_id long, source string, text string, url string")


def test_briefing_goldens(spark):
    got = {r.doc_id: r for r in brief(sample(spark)).collect()}
    assert [got[i].intake for i in (1, 2, 3)] == ["admit", "reject_thin", "social_downweight"]
    assert (got[1].substance_band, got[2].substance_band) == ("dense", "thin")
    assert got[1].source_class == got[4].source_class == "policy_instrument"  # an instrument outranks the ministry it names
    assert got[4].desk == "hot_topics" and "critical_minerals" in got[4].themes
    assert got[5].nexus == "direct" and got[2].nexus == "none"
    for r in got.values():
        for f in r.facts:
            assert r.text[f.start : f.end] == f.value
    money = [f for f in got[1].facts if f.kind == "money"]
    assert float(money[0].amount) == 350_000_000 and money[0].vehicle == "special funds"


def test_signals_count_and_weigh():
    assert len(MANDARIN.signals) == 23 and sum(s.weight for s in MANDARIN.signals) == 131


def test_text_without_cues_is_medium(spark):
    card = scoring.scorecard(spark.createDataFrame([(1, "无关文字")], "doc_id int, text string"), MANDARIN).first()
    assert card.signal_band == "medium" and card.n_hit == 0


def test_band_rises_with_cues(spark):
    parts = ["商务部", "印发通知", "专项资金3亿元", "2026年底前", "试点", "严禁"]
    rows = [(i, "。".join(parts[: i + 1])) for i in range(len(parts))]
    got = substance.cut(spark.createDataFrame(rows, "doc_id int, text string"), MANDARIN).orderBy("doc_id").collect()
    scores = [r.substance_milli for r in got]
    assert scores == sorted(scores) and got[-1].substance_band == "dense"


def test_rows_may_come_in_any_order(spark):
    rows = brief(sample(spark)).select("doc_id", "desk", "grade", F.col("nuggets").cast("string").alias("n"))
    again = brief(sample(spark).repartition(7, F.rand(3))).select("doc_id", "desk", "grade", F.col("nuggets").cast("string").alias("n"))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, again.collect()))


def test_gray_zone_override(spark):
    rows = spark.createDataFrame([(1, "关键矿产", "admit"), (2, "无关", "admit"), (3, "关键矿产", None)], "doc_id int, text string, forced string")
    rows = decisions.adoption(substance.cut(rows, MANDARIN), MANDARIN).withColumn("source_class", F.lit("unknown_public"))
    got = {r.doc_id: r.intake for r in decisions.intake(rows, MANDARIN, "forced").collect()}
    assert got == {1: "admit", 2: "reject_thin", 3: "defer"}


def test_independent_pair_is_the_first(spark):
    rows = spark.createDataFrame([("r", 1, ["a"]), ("r", 2, []), ("r", 3, ["a", "b"]), ("r", 4, ["b"]), ("r", 5, ["c"]), ("q", 1, ["a"])], "run string, i int, iss array<string>")
    assert list(map(tuple, crossing.independent_pair(rows, "run", "iss", "i").collect())) == [("r", 1, 4)]


def test_sources(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"version": 1, "allowedHosts": ["a.org"], "entries": [{"id": "x", "type": "rss"}, {"id": "y", "type": "url", "enabled": False}]}))
    assert [r.id for r in feeds.read_whitelist(spark, str(tmp_path / "w.json")).collect()] == ["x"]
    (tmp_path / "s.json").write_text(json.dumps({"subscriptions": [{"id": "a", "scheduleCron": "0 8 * * *", "scheduleHuman": "daily", "delivery": ["rss"]}, {"id": "b", "active": False}]}))
    assert [(r.id, r.scheduleCron, r.scheduleHuman, r.delivery) for r in feeds.read_subscriptions(spark, str(tmp_path / "s.json")).collect()] == [("a", "0 8 * * *", "daily", ["rss"])]
    urls = spark.createDataFrame([("https://A.org:80/x",), ("https://u:p@a.org/",), ("ftp://a.org/",), ("http://127.0.0.1/",), ("not a url",), (None,)], "url string")
    assert [r.url for r in feeds.allowed(urls, spark.createDataFrame([("a.ORG",), ("127.0.0.1",)], "host string")).collect()] == ["https://A.org:80/x"]
    items = spark.createDataFrame([(1, True, "chinese", True), (2, True, "non_chinese", True), (3, None, None, None)], "i int, in_scope boolean, language_quality string, has_concrete_detail boolean")
    assert [r.i for r in feeds.admit(items).collect()] == [1, 3]


def test_records(spark, tmp_path):
    rows = spark.createDataFrame([("1", "s", "2026-01-01 00:00:00", "https://a", None), ("2", "t", "2026-01-02 00:00:00", None, None)], "id string, subscription_id string, created_at string, url string, provenance string")
    rows = rows.withColumn("created_at", F.col("created_at").cast("timestamp"))
    records.write_records(rows, str(tmp_path / "r"))
    assert {r.id: r.provenance for r in records.list_records(spark, str(tmp_path / "r")).collect()} == {"1": "live", "2": "fixture_demo"}
    assert [r.id for r in records.restore(rows, rows.where("id = '1'")).collect()] == ["2"]
    (tmp_path / "bad.json").write_text('{"id": "1"}\n{oops\n{"id": "2"}\n')
    assert sorted(r.id for r in records.read_json_records(spark, str(tmp_path / "bad.json"), "id string").collect()) == ["1", "2"]
    (tmp_path / "c.md").write_text('---\nname: card\ntype: odd\ndesk: overall_goals, defense\nmatch: ["a b", "c"]\n---\nBody\n')
    card = records.read_cards(spark, str(tmp_path / "c.md")).first()
    assert (card.name, card.type, card.desks, card.match, card.body) == ("card", "lexicon", ["economy_investment", "defense"], ["a b", "c"], "Body")
    for kind in ("institution", "lexicon", "history_frame", "intl_compare", "method"):
        (tmp_path / "cards").mkdir(exist_ok=True)
        (tmp_path / "cards" / f"{kind}.md").write_text(f'---\nname: {kind}\ntype: {kind}\ndesk: all\nmatch: ["a b"]\n---\nBody\n')
    catalog = scoring.card_catalog(records.read_cards(spark, str(tmp_path / "cards")))
    found = scoring.match_cards(spark.createDataFrame([(1, "a b", "x")], "doc_id int, text string, desk string"), catalog).collect()
    assert {r.card: r.score for r in found} == {"method": 1250, "institution": 900, "history_frame": 850, "intl_compare": 850, "lexicon": 750}


def test_nuggets_have_english(spark):
    """Where no fact explains a nugget its English is its terms', else what its kind is called; never null, never Mandarin."""
    rows = spark.createDataFrame([(1, "某单位首次召开网络安全周活动，有关人员当选，印发通知，2026年底前完成，安排专项资金3亿元。")], "doc_id int, text string")
    from cuelens.operators import facts

    got = substance.cut(facts.facts(rows), MANDARIN).first().nuggets
    english = {n.kind: n.value_en for n in got}
    assert all(n.value_en and not any("\u4e00" <= c <= "\u9fff" for c in n.value_en) for n in got)
    assert english["official_action"] == "a named official action (see quoted excerpt)" and english["timeline"] == "by end-2026"


def test_board_gathers_gaps(spark):
    from cuelens.operators import history

    rows = [("a", 1, "x", True, False, ["second_source", "named_instrument"]), ("a", 3, "y", False, True, ["named_instrument"]), ("b", 2, "x", False, False, [])]
    got = history.board(spark.createDataFrame(rows, "desk string, score int, role string, direction boolean, instrument boolean, missing array<string>"), "desk").orderBy("desk").collect()
    assert [(r.desk, r.n_items, r.pairable, r.gaps) for r in got] == [("a", 2, True, "named_instrument,second_source"), ("b", 1, False, "")]


def test_corroboration_drivers(spark):
    """A cross-checked run, one of the same issuer, one of wording alone, one alone: score, drivers and gaps of each."""
    kind = "run string, i int, subjects array<string>, issuers array<string>, details array<string>, phrases array<string>, traceable boolean, has_instrument boolean, has_meeting boolean, thin boolean"
    rows = [
        ("apart", 1, ["s"], ["a"], ["3%"], [], False, True, False, False), ("apart", 2, ["s"], ["b"], ["3%"], [], False, False, True, True),
        ("same", 3, ["s"], ["a"], [], [], False, False, True, True), ("same", 4, ["s"], ["a"], [], [], False, False, False, True),
        ("words", 5, ["s"], [], [], ["p", "q", "r"], False, True, False, False), ("words", 6, ["t"], [], [], ["p", "q", "r"], False, True, False, False),
        ("alone", 7, ["s"], ["a"], ["3%"], ["p"], True, True, True, False),
    ]
    got = {r.run: (r.corroboration, r.n_details, r.drivers, r.missing) for r in crossing.corroborate(spark.createDataFrame(rows, kind), "run", "i", "i").collect()}
    assert got == {
        "apart": (3, 1, ["cross_source_subject_match", "cross_source_detail_match", "independent_issuer_agreement"], []),
        "same": (2, 0, ["cross_source_subject_match"], ["other_issuer", "named_instrument", "document_for_meeting", "checkable_detail"]),
        "words": (1, 0, ["cross_source_topic_overlap_only"], ["same_subject_wording"]), "alone": (1, 0, ["single_source_names_traceable_record"], ["second_source"]),
    }
