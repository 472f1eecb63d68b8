"""Work per row: what is expensive is matched once, and only where it can occur."""

from pyspark.sql import functions as F

from cuelens.functions.dialect import branches
from cuelens.functions.text import first_spans, holds, spans
from cuelens.lexicon import CORPUS
from cuelens.operators import relating, substance
from cuelens.plans import registry

TEXTS = [
    "", "the", "12 a12 123 12 7 12 99 123 5", "Licensed under MIT-2.0 and Released under x", "mail a.b@c.org, x@y", "1.2.3.4 1.2.3", "ABC!! AB!! é ABC!!",
    "a | b c | d a | b", "übergroß 😀 1999 😀 2001 1999 2020 2003 2004", "idiots and clowns", "### *** $$", "line\nline\n", "+1 234 567 890 1 234 567 890", None,
]


def test_keys_of_related_records_are_computed_once(spark, monkeypatch):
    plans = []
    real = relating.kept
    monkeypatch.setattr(relating, "kept", lambda rows, name: plans.append((name, rows._jdf.queryExecution().optimizedPlan().toString())) or real(rows, name))
    rows = spark.createDataFrame([(1, "a,b"), (2, "a,c"), (3, "d")], "id long, t string")
    rows = rows.select("id", F.col("id").alias("created"), F.split(F.concat(F.lit("desk:x,kind:y,"), "t"), ",").alias("keys"), F.lit("none").alias("nexus"))
    assert relating.related(rows).count() == 6
    assert dict(plans)["keyed"].count("split(") == 1


def test_what_grows_with_key_sets_is_not_broadcast(spark, monkeypatch):
    """Spark takes an exploded table for as small as its Parquet files; hot keys alone may go through the driver."""
    plans = []
    real = relating.kept
    seen = lambda rows: plans.extend(rows._jdf.queryExecution().executedPlan().toString().splitlines())
    monkeypatch.setattr(relating, "kept", lambda rows, name: seen(rows) or real(rows, name))
    monkeypatch.setattr(relating, "FEW_HOLDERS", 2)
    rows = spark.createDataFrame([(i, f"desk:x,kind:y,a{i % 3},b{i % 5},c{i}") for i in range(40)], "id long, t string")
    seen(relating.related(rows.select("id", F.col("id").alias("created"), F.split("t", ",").alias("keys"), F.lit("direct").alias("nexus"))))
    assert not [x for x in plans if ("BroadcastHashJoin" in x or "BroadcastNestedLoopJoin" in x) and "hot_key" not in x]
    assert any("SortMergeJoin" in x for x in plans)


def test_nuggets_are_computed_once(spark):
    rows = spark.createDataFrame([(1, "7 apples cost 1999")], "doc_id long, text string")
    cut = substance.cut(rows, CORPUS).where("size(nuggets) > 0").select("substance_milli", "substance_band", F.size("nuggets").alias("n"))
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("named_instrument AS kind") <= 1 and plan.count("Generate explode") == 1
    assert plan.count("trim(transform(") == 1  # of the clause around a nugget
    assert cut.collect()[0].n == 3


def test_first_spans_are_the_first_distinct_of_all_spans(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    for rule in CORPUS.detectors:
        for row in rows.select("text", spans(F.col("text"), rule.pattern).alias("all"), first_spans(F.col("text"), rule.pattern, 4).alias("first")).collect():
            want = {}
            for x in row["all"]:
                want.setdefault(x.value, x)
            assert row["first"] == list(want.values())[:4], (rule.name, row.text)


def test_fixed_texts_of_patterns(spark):
    assert branches(r"[a-z]+@x\.org|plain|a?bc*d|(x|y) z{2}") == [(r"[a-z]+@x\.org", "@x.org", False), ("plain", "plain", True), ("a?bc*d", "b", False), ("(x|y) z{2}", " ", False)]
    assert branches("(?i)abc") == [("(?i)abc", "", False)]
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    for rule in (*CORPUS.detectors, *CORPUS.kinds, *CORPUS.themes, *CORPUS.social):
        both = rows.select(holds(F.col("text"), rule.pattern).alias("a"), F.col("text").rlike(rule.pattern).alias("b")).collect()
        assert all(r.a == r.b for r in both), rule.name
    mail = rows.select(holds(F.col("text"), CORPUS.nexus_direct[0].pattern).alias("x"))
    assert "Contains(text" in mail._jdf.queryExecution().optimizedPlan().toString()


def test_a_table_of_one_row_group_is_dealt_by_its_bytes(spark, tmp_path, monkeypatch):
    spark.range(20000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(registry, "TASK_BYTES", 1 << 16, raising=False)
    monkeypatch.setattr(registry, "SPREAD_BYTES", 0, raising=False)
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert registry.spread(rows).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_equal_texts_are_read_once(spark, monkeypatch):
    from cuelens.plans import briefing

    monkeypatch.setattr(briefing, "MANY", 3)
    rows = spark.createDataFrame([(i, f"t{i % 3 if i < 30 else 9}", i % 2) for i in range(40)], "doc_id long, text string, extra int")
    seen = []

    def work(texts):
        seen.append(texts.count())
        return texts.withColumn("size", F.concat("text", F.lit("!")))

    got = briefing.each_text_once(rows, ["text"], work)
    assert seen == [4]
    assert sorted((r.doc_id, r.text, r.extra, r["size"]) for r in got.collect()) == [(i, t, i % 2, t + "!") for i in range(40) for t in [f"t{i % 3 if i < 30 else 9}"]]


def test_texts_of_corroborated_sources_are_read_twice_at_most(spark, tmp_path):
    from cuelens.plans import crosschecks

    rows = [(i, f"the thing {i} was Licensed under MIT {1000 + i % 3} for all", "en", f"src{i % 4}") for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = crosschecks.corroborated(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") + plan.count("regexp_replace(text") <= 2  # one for the pastes of the phrases
    got = found.collect()
    assert [(r.n_sources, r.n_subjects, r.corroboration) for r in got] == [(12, 2, 3)]


def test_words_and_digits_of_patterns(spark):
    from cuelens.functions.dialect import needs_digit, words

    assert words("(^| )(les?|du)( |$)") == ["le", "les", "du"] and words("(^| )(le|d.)( |$)") == [] and words("x(^| )(le)( |$)") == []
    assert all(needs_digit(p) for p in (r"\d", r"x\d+", r"(19|20)\d\d", r"\+?\d[\d -]{7,}\d", r"\d{1,3}\."))
    assert not any(needs_digit(p) for p in (r"a\d*", r"a\d?b", r"\d{0,3}a", r"a|\d", r"[\d]a", r"\\d", r"(a\d)?b", "(?i)\\d"))
    rows = spark.createDataFrame([(t,) for t in ("the", "the end", "in the", "in the end", "in\nthe", "other then", "the the")], "text string")
    found = rows.select(holds(F.col("text"), "(^| )(the|of)( |$)").alias("x")).collect()
    assert [r.x for r in found] == [True, True, True, True, False, False, True]


def test_marks_tell_what_patterns_match(spark):
    from cuelens.functions.text import marked, matches, seen
    from cuelens.lexicon.rules import cut_patterns, triage_patterns

    patterns = list(dict.fromkeys(triage_patterns(CORPUS) + cut_patterns(CORPUS)))
    rows = marked(spark.createDataFrame([(t,) for t in TEXTS], "text string"), patterns)
    both = [(holds(seen(rows), p), F.coalesce(F.col("text").rlike(p), F.lit(False))) for p in patterns]
    for row in rows.select("text", *[F.array(a, b) for a, b in both]).collect():
        assert all(x[0] == x[1] for x in row[1:]), row
    for p in patterns:
        assert all(r.a == r.b for r in rows.select(matches(seen(rows), p).alias("a"), matches(F.col("text"), p).alias("b")).collect()), p


def test_cues_of_a_text_are_looked_for_once_by_board_and_cards(spark, tmp_path):
    from cuelens.plans import crosschecks, screening

    spark.createDataFrame([(1, "the thing ### cost 120 at a@b.org and more", "en", "src1")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    for query in (crosschecks.q28_section_board, screening.q12_ontology_top8):
        spark.conf.set("spark.sql.debug.maxToStringFields", "1000")  # else a plan's text leaves out fields
        plan = query(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        spark.conf.unset("spark.sql.debug.maxToStringFields")
        assert plan.count("[#*$%&]{3,}") == 1 and plan.count("[A-Za-z]{2,}") == 1, query.__name__
        assert query(spark, str(tmp_path)).count() > 0


def test_a_table_of_narrow_rows_is_dealt_by_its_rows(spark, tmp_path, monkeypatch):
    from cuelens.plans import reader

    spark.range(3000).selectExpr("id o_orderkey", "id % 5 o_custkey", "timestamp_ntz'1999-01-01' o_orderdate", "'3-MEDIUM' o_orderpriority").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(registry, "TASK_ROWS", 100, raising=False)
    dated = reader.dated(spark, str(tmp_path))
    assert dated.rdd.getNumPartitions() == 30 and dated.where("as_of.date = '1999-01-01'").count() == 3000


def test_days_are_those_of_the_calendar(spark):
    import calendar

    from cuelens.functions.dates import absolute_dates, calendar_day

    years = (1989, 1990, 1999, 2000, 2004, 2099, 2100, 2101)
    rows = spark.createDataFrame([(y, m, d) for y in years for m in range(14) for d in range(40)], "y int, m int, d int")
    for r in rows.select("*", calendar_day(F.col("y"), F.col("m"), F.col("d")).cast("string").alias("day")).collect():
        real = 1990 <= r.y <= 2100 and 1 <= r.m <= 12 and 1 <= r.d <= calendar.monthrange(r.y, r.m)[1]
        assert r.day == (f"{r.y:04d}-{r.m:02d}-{r.d:02d}" if real else None), r
    plan = rows.select(absolute_dates(F.concat("y", F.lit("-01-01"))))._jdf.queryExecution().optimizedPlan().toString()
    assert "gettimestamp" not in plan and "try_to_date" not in plan


def test_documents_without_a_label_are_not_screened(spark, tmp_path):
    from cuelens.plans import crosschecks

    rows = [(i, f"the thing {i} was Licensed under MIT {1000 + i} for all", "en", "src1") for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = crosschecks.q36_gold_eval(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") > plan.rindex("Generate")  # the join is below all that reads texts
    assert [tuple(r) for r in found.select("zone", "n", "n_right", "false_admit", "false_reject").collect()] == [("en", 2, 1, 1, 0)]
