"""Normalisation, planning and periods by truth tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from speechmill.functions import periods as P
from speechmill.functions import text as X
from speechmill.operators import ranking as R
from speechmill.plans.query_text import Plan, canonical_query, match_topic, probe_keys, related_topics, split_terms, to_full_width, unsearchable_terms, word_plan

COUNTS = {"ＡＩ": 5232, "憲法": 1369, "増税": 314}


def column(spark, values, f, kind="string"):
    return [r.o for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(f(F.col("v")).alias("o")).collect()]


def test_widths():
    assert [to_full_width(x) for x in ("AI", "LGBT法案", "Ｇ７", "憲法")] == ["ＡＩ", "ＬＧＢＴ法案", "Ｇ７", "憲法"]
    assert split_terms("AI 規制") == ["ＡＩ", "規制"]
    assert split_terms("  LGBT　理解増進 ") == ["ＬＧＢＴ", "理解増進"]
    assert canonical_query("ai SDGs 規制") == "ＡＩ ＳＤＧｓ 規制"
    assert canonical_query("憲法  年金") == "憲法  年金"


def test_limits():
    assert len(split_terms(" ".join(["あ"] * 21))) == 16
    assert len(split_terms("あ" * 164)[0]) == 64
    assert len(canonical_query("あ" * 5000)) == 64


@pytest.mark.parametrize("query, driver, filters", [("ai", "ＡＩ", ()), ("ai 増税", "増税", ("ＡＩ",)), ("ai 憲法", "憲法", ("ＡＩ",)), ("憲法 増税", "増税", ("憲法",)), ("ai SDGs", "ＡＩ", ("ＳＤＧｓ",)), ("ｑｚ", "ＱＺ", ()), ("ai qz", "ＱＺ", ("ＡＩ",)), ("  ", "", ())])
def test_word_plans(query, driver, filters):
    plan = word_plan(split_terms(query), COUNTS)
    assert (plan.mode, plan.driver, plan.filters) == ("word", driver, filters)


def test_fts_plan():
    assert word_plan(split_terms("SDGs"), COUNTS) == Plan("fts", terms=("ＳＤＧｓ",))
    assert probe_keys(split_terms("ai 憲法 SDGs")) == ["ＡＩ", "憲法"]


def test_unsearchable():
    assert unsearchable_terms([to_full_width(t) for t in ("治体", "憲法", "コロ", "AI", "G7", "踏まえ")]) == []
    assert unsearchable_terms(["踏ま", "お金", "ため", "米", "Ａ"]) == ["踏ま", "お金", "ため", "米", "Ａ"]


def test_topics():
    topics = [{"id": 1, "term": "ＳＤＧｓ", "variants": ["持続可能"], "indexed": True}, {"id": 2, "term": "憲法", "variants": [], "indexed": False}]
    assert (match_topic("sdgs", topics), match_topic("持続可能", topics), match_topic("憲法", topics), match_topic(" ", topics)) == (1, 1, None, None)
    assert related_topics("dg", topics) == [1]


def test_runs_and_grams(spark):
    text = "安全保障はＳＤＧｓとデータ。米"
    assert column(spark, [text, "", None], X.runs) == [["安全保障", "ＳＤＧｓ", "データ"], [], None]
    assert column(spark, [text], X.run_bigrams) == [["安全", "全保", "保障", "ＳＤ", "ＤＧ", "ＧＳ", "デー", "ータ"]]
    assert column(spark, ["ab", "a", ""], lambda c: X.ngrams(c, 2)) == [["ab"], [], []]


def test_occurrences_and_snippets(spark):
    assert column(spark, ["ああああ", "い", ""], lambda c: X.occurrences(c, F.lit("ああ"))) == [2, 0, 0]
    assert column(spark, ["x" * 60 + "語" + "y" * 200], lambda c: X.snippet(c, F.lit("語")))[0] == "x" * 40 + "語" + "y" * 119
    assert column(spark, ["ABC語DEF", "none"], lambda c: X.marked_snippet(c, F.lit("語"), opening="[", closing="]")) == ["ABC[語]DEF", None]


def test_markup(spark):
    assert column(spark, ["<b>Data & data</b>"], lambda c: X.highlight(c, ["data", "da"])) == ["&lt;b&gt;<mark>Data</mark> &amp; <mark>data</mark>&lt;/b&gt;"]
    assert column(spark, ["  a\n\n　b　\n "], X.paragraphs) == [["a", "b"]]
    assert column(spark, [" https://a.example/x ", "javascript:x", "http://a b", None], X.safe_url) == ["https://a.example/x", None, None, None]


def test_periods(spark):
    days = [dt.date(2026, 1, 23), dt.date(2026, 6, 30), dt.date(2026, 7, 1), dt.date(2026, 12, 31), None]
    assert column(spark, days, P.period_of, "date") == ["2026H1", "2026H1", "2026H2", "2026H2", None]
    assert column(spark, ["120214261X00120260123_0", "120214261X00120260701_12", "bad", None], P.period_of_speech_id) == ["2026H1", "2026H2", None, None]
    assert P.periods_in_years(["2024H1", "2024H2", "2025H1", "2026H1"], 2025, 2024) == ["2025H1", "2024H2", "2024H1"]
    assert [r.month for r in P.calendar(spark, dt.date(2025, 11, 5), dt.date(2026, 1, 2)).collect()] == ["2025-11", "2025-12", "2026-01"]
    assert P.month_chunks(dt.date(2025, 12, 30), dt.date(2026, 2, 3)) == [(dt.date(2025, 12, 30), dt.date(2025, 12, 31)), (dt.date(2026, 1, 1), dt.date(2026, 1, 31)), (dt.date(2026, 2, 1), dt.date(2026, 2, 3))]
    clip = spark.createDataFrame([("2026H2", dt.date(2026, 7, 1), dt.date(2026, 7, 31)), ("2025H1", dt.date(2021, 1, 1), dt.date(2026, 1, 1)), ("2020H1", dt.date(2021, 1, 1), dt.date(2021, 2, 1))], "p string, a date, b date")
    assert [r.o for r in clip.select(P.months_in_period(F.col("p"), F.col("a"), F.col("b")).alias("o")).collect()] == [["2026-07"], [f"2025-0{m}" for m in range(1, 7)], []]


def test_ranges(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 5, 5, 9, 10, None)], "id int")
    assert R.id_ranges(df, "id").first().ids == "1-3,5,9-10"
    assert column(spark, ["1-3,5", "x", "", "4"], R.parse_ranges) == [[1, 2, 3, 5], [], [], [4]]


PEOPLE = [(1, "林芳正", "はやしよしまさ", "青雲", 30), (2, "小林鷹之", "こばやしたかゆき", "青雲", 50), (3, "森 林太", "もりりんた", None, 5), (4, "林", "りん", "緑林会", 1), (5, "山田", "ヤマダ", "林野会", 9)]


def test_name_search(spark):
    people = spark.createDataFrame(PEOPLE, "id int, name string, kana string, kaiha string, n int")
    assert [r.id for r in R.match_names(people, "林").collect()] == [4, 1, 2, 3, 5]
    assert [r.id for r in R.match_names(people, "ハヤシ").collect()] == [1]
    assert [r.id for r in R.match_names(people, "こばや し").collect()] == [2]
    assert R.match_names(people, " 　").count() == 0
    assert [r.id for r in R.match_names(people, "林", limit=2).collect()] == [4, 1]


def test_typed_order(spark):
    df = spark.createDataFrame([(v,) for v in ("き", "が", "か", "カ", "漢", "", None)], "v string")
    up = [r.v for r in df.orderBy(*R.typed_order("v")).collect()]
    assert up[-2:] in (["", None], [None, ""]) and up.index("か") < up.index("が") < up.index("き") < up.index("漢")
    numbers = spark.createDataFrame([(v,) for v in ("10", "9", " ", "100")], "v string")
    assert [r.v for r in numbers.orderBy(*R.typed_order("v", "num")).collect()] == ["100", "10", "9", " "]
    assert [r.v for r in numbers.orderBy(*R.typed_order("v", "num", False)).collect()] == ["9", "10", "100", " "]
