"""Dialect, offsets, claims, placeholders, markup and dates."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from cuelens.functions import dates, markup, text
from cuelens.functions.dialect import java, re2
from cuelens.lexicon.mandarin import RELATIVE_DATES


def one(spark, column, *values, schema="a string"):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("pattern", "hay", "want"),
    [(r"\bCanada\b", "在Canada投资", True), (r"\bCanada\b", "Canadas", False), (r"年\s底", "年　底", True), (r"[\s，]底", "年　底", True), ("坚持(?!党)[^。]{0,3}推动", "坚持党推动", False)],
)
def test_java_dialect(spark, pattern, hay, want):
    assert one(spark, F.col("a").rlike(java(pattern)), hay) is want


def test_re2_refuses_lookaround():
    assert re2(r"\bG7\b") == r"\bG7\b"
    with pytest.raises(ValueError, match="RE2"):
        re2("a(?!b)")


def test_spans_match_python(spark):
    rng = random.Random(1)
    rows = ["".join(rng.choice("ab1😀中 ") for _ in range(rng.randrange(40))) for _ in range(60)]
    got = spark.createDataFrame([(r,) for r in rows], "a string").select("a", text.spans(F.col("a"), r"\d+|a+b?").alias("s")).collect()
    for r in got:
        assert [(x.start, x.end, x.value) for x in r.s] == [(m.start(), m.end(), m.group()) for m in re.finditer(r"\d+|a+b?", r.a)]
    assert one(spark, text.spans(F.col("a"), "x"), None) == []


def test_claims_are_greedy(spark):
    cands = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(v).alias("value")) for s, e, v in ((1, 4, "BCD"), (0, 2, "AB"), (4, 5, "E"), (2, 5, "CDE"))])
    assert [x.value for x in one(spark, text.claim(cands), "")] == ["BCD", "E"]


def test_placeholders_in_one_pass(spark):
    got = one(spark, text.placeholders(F.col("a"), F.array(F.lit("paste-2"), F.lit("$1"))), "paste-1 and paste-2, paste-3 paste-0")
    assert got == "paste-2 and $1, paste-3 paste-0"


def test_markup(spark):
    html = "<p>a&amp;lt;b</p><!-- x --><script>no()</script>\n c"
    assert one(spark, markup.html_text(F.col("a")), html) == "a&lt;b c"
    xml = "<item><title><![CDATA[T & 1]]></title><description>&lt;b&gt;d&lt;/b&gt;</description></item><item><link>u</link></item><item><title>2</title></item>"
    items = one(spark, markup.rss_items(F.col("a"), 2), xml)
    assert [(i.title, i.description) for i in items] == [("T & 1", "d")]
    assert one(spark, markup.xml_escape(F.col("a")), '<&">') == "&lt;&amp;&quot;&gt;"


def test_dates(spark):
    got = one(spark, dates.absolute_dates(F.col("a")), "2026年2月30日，2025年3月5日，2025-03-05 和 2024年7月")
    assert [(x.date, x.precision) for x in got] == [(datetime.date(2025, 3, 5), "day"), (datetime.date(2024, 7, 1), "month")]
    now = F.lit("2026-01-10").cast("date")
    assert one(spark, dates.as_of(F.col("a"), RELATIVE_DATES, now), "昨日消息").method == "relative"
    assert one(spark, dates.as_of(F.col("a"), RELATIVE_DATES, now), "2025-12-01 昨日").method == "absolute"
    assert one(spark, dates.as_of(F.col("a"), RELATIVE_DATES, now), "新华社北京2025年12月1日电").method == "wire"
    assert one(spark, dates.as_of(F.col("a"), RELATIVE_DATES, now), "没有").method == "none"
    assert one(spark, dates.as_of(F.col("a"), RELATIVE_DATES, now), "x" * 159 + "昨日").method == "relative"  # a cue may start in the last of 160 characters
    assert one(spark, dates.as_of(F.col("a"), RELATIVE_DATES, now), "x" * 160 + "昨日").method == "none"


def test_dates_are_matched_once(spark):
    """However many fields are taken, the plan holds each form of a date once, with the numbers of its match."""
    from cuelens.functions import dates
    from cuelens.functions.text import held
    from cuelens.lexicon.mandarin import RELATIVE_DATES

    rows = held(spark.createDataFrame([("2025-12-01",)], "text string"), "d", dates.as_of(F.col("text"), RELATIVE_DATES, F.lit("2026-01-01").cast("date")))
    plan = rows.select("d.date", "d.method", "d.precision", F.concat("d.method", "d.precision"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 6 and plan.count("split(") <= 3
