"""The three search paths over a small fixture: rows, count and months agree on every path and filter, and pages walk the whole."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from speechmill.operators.facts import number_in_periods
from speechmill.operators.postings import bigram_postings, document_frequency, letter_postings, posting_lists, topic_postings
from speechmill.operators.quality import month_bounds
from speechmill.plans import search as S
from speechmill.plans.query_text import Plan, split_terms, word_plan

T, W = "安全保障", "憲法"
#: id, meeting, politician, kind, month, holds T, holds W
ROWS = [
    (1, "A", 1, "議員", 1, 1, 1), (2, "A", 1, "議員", 1, 1, 0), (3, "A", 2, "議員", 1, 0, 1), (4, "A", 2, "議員", 1, 1, 0), (5, "A", None, "参考人", 2, 1, 1), (6, "B", 1, "議員", 2, 1, 0), (7, "B", 1, "議員", 2, 0, 0), (8, "B", 1, "議員", 2, 0, 1),
    (9, "B", 1, "議員", 3, 1, 1), (10, "B", 2, "議員", 3, 0, 1), (11, "B", 2, "議員", 3, 1, 1), (12, "B", 3, "議員", 3, 1, 0), (13, "B", None, "政府参考人等", 4, 1, 0), (14, "B", 3, "議員", 4, 0, 0), (15, "A", 2, "議員", 4, 0, 0), (16, "B", 1, "議員", 4, 0, 1),
]
EXTRA = {14: "ＬＧＢＴとＳＤＧｓ。", 15: "ＡＩとＧ７。", 16: "ＡＩ。"}
TOPICS = [{"id": 1, "term": T, "category": "x", "variants": []}]
PLANS = {"fts": Plan("fts", terms=(T,)), "word": Plan("word", driver=W), "topic": Plan("topic", topic=1), "filtered": Plan("word", driver=W, filters=(T,))}
FILTERS = {"none": {}, "meeting": {"meeting": "内閣委員会"}, "person": {"politician": 1}, "both": {"meeting": "内閣委員会", "politician": 1}, "absent": {"meeting": "無い委員会"}}
COUNTS = {"fts": (7, 3, 4, 2, 0), "topic": (7, 3, 4, 2, 0), "word": (7, 2, 4, 1, 0), "filtered": (3, 1, 2, 1, 0)}
MONTHS = {"fts": [3, 1, 3, 0], "topic": [3, 1, 3, 0], "word": [2, 1, 3, 1], "filtered": [1, 0, 2, 0]}
IDS = {"fts": [12, 11, 9, 6, 4, 2, 1], "topic": [12, 11, 9, 6, 4, 2, 1], "word": [16, 11, 10, 9, 8, 3, 1], "filtered": [11, 9, 1]}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"{m}_{i}", m, i, dt.date(2026, month, 5), "x", "甲", p, ("前置き。" + (f"{T}の" if t else "") + (f"{W}を" if w else "") + EXTRA.get(i, "")), k, "2026H1") for i, m, p, k, month, t, w in ROWS]
    speech = spark.createDataFrame(rows, "rowid long, speech_id string, issue_id string, speech_order int, date date, speaker string, speaker_group string, politician_id int, body string, speaker_kind string, period string").cache()
    meeting = spark.createDataFrame([("A", "内閣委員会", "衆議院", 1), ("B", "予算委員会", "参議院", 1)], "issue_id string, name string, house string, session int").cache()
    return speech, meeting


@pytest.mark.parametrize("plan, filters", list(itertools.product(PLANS, FILTERS)))
def test_rows_count_months_agree(corpus, plan, filters):
    speech, meeting = corpus
    options = S.Options(**FILTERS[filters], limit=100)
    found = S.hits(speech, meeting, options, PLANS[plan], TOPICS).cache()
    rows = S.result_rows(S.page(found, options), meeting, PLANS[plan], TOPICS).collect()
    months = {r.month: r.n for r in S.months(found).collect()}
    assert len(rows) == S.count(found).first().n == sum(months.values()) == COUNTS[plan][list(FILTERS).index(filters)]
    if filters == "none":
        assert [months.get(f"2026-0{m}", 0) for m in range(1, 5)] == MONTHS[plan]
        assert sorted((r.rowid for r in rows), reverse=True) == IDS[plan]
    for r in rows:
        assert "meeting" not in FILTERS[filters] or r.meeting == "内閣委員会"
        assert "politician" not in FILTERS[filters] or r.politician_id == 1


@pytest.fixture(scope="module")
def index(corpus):
    members, keep = S.population(corpus[0]), ["period", "rowid"]
    pairs = bigram_postings(members, keep)
    return S.Index(posting_lists(pairs), posting_lists(letter_postings(members, keep)), topic_postings(members, TOPICS, keep), document_frequency(pairs, ["period", "term"]), month_bounds(corpus[0]))


@pytest.mark.parametrize("plan, filters", list(itertools.product([*PLANS, "long", "none", "wide"], ["none", "both"])))
def test_posting_lookup_is_the_same(corpus, index, plan, filters):
    speech, meeting = corpus
    plan = {**PLANS, "long": Plan("fts", terms=("安全保障", "憲法を")), "none": Plan("fts", terms=("ab",)), "wide": Plan("fts", terms=("ｓｄｇ",))}[plan]
    asked = (speech, meeting, S.Options(**FILTERS[filters], limit=3, periods=("2026H1", "2025H2")), plan, TOPICS)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(S.hits(*asked).select("rowid")) == rows(S.hits(*asked, index).select("rowid"))
    assert rows(S.page_hits(*asked).select("rowid")) == rows(S.page_hits(*asked, index).select("rowid"))
    assert rows(S.count_hits(*asked)) == rows(S.count_hits(*asked, index)) and rows(S.month_hits(*asked)) == rows(S.month_hits(*asked, index))


def test_letter_windows(spark):
    df = spark.createDataFrame([(1, "AbCdab"), (2, "ab"), (3, ""), (4, None), (5, "年金の𠮷年金の")], "rowid long, body string").withColumn("period", F.lit("p"))
    got = {}
    for r in letter_postings(df, ["rowid"]).collect():
        got.setdefault(r.rowid, set()).add(r.term)
    assert got[1] == {"abc", "bcd", "cda", "dab"} and set(got) == {1, 5} and {"年金の"} <= got[5]
    assert S.letter_keys("年金の𠮷") == ["年金の"] and S.letter_keys("𠮷") == []


def test_pages_of_a_person_cover_all(corpus):
    speech, _ = corpus
    before, rows, done = {}, [], False
    while not done:
        shown = S.timeline_page(speech, 1, ["2026H1"], S.Options(limit=3, before=before))
        rows, before, done = rows + shown.rows, shown.before, shown.done
    assert [r for _, r in rows] == [16, 9, 8, 7, 6, 2, 1]
    assert S.active_periods(dt.date(2024, 7, 1), dt.date(2025, 3, 1), ["2023H1", "2024H1", "2024H2", "2025H1", "2025H2"]) == ["2025H1", "2024H2"]
    assert S.active_periods(None, None, ["2023H1", "2024H1"]) == ["2024H1", "2023H1"]


def test_walk_numbers_every_hit(corpus):
    speech, meeting = corpus
    found = S.hits(speech, meeting, S.Options(), PLANS["fts"], TOPICS)
    assert [(r.place, r.page, r.rowid) for r in S.walk(found, 3).orderBy("place").collect()] == [(k, k // 3, i) for k, i in enumerate(IDS["fts"])]


@pytest.mark.parametrize("query, ids", [("LGBT", [14]), ("SDGs", [14]), ("sdgs", [14]), ("ＳＤＧｓ", [14]), ("AI", [15, 16]), ("ai", [15, 16]), ("ａｉ", [15, 16]), ("G7", [15]), ("踏ま", []), ("", []), ("ＱＺ", [])])
def test_width_and_case(corpus, query, ids):
    speech, meeting = corpus
    plan = word_plan(split_terms(query), {})
    assert sorted(r.rowid for r in S.hits(speech, meeting, S.Options(), plan).collect()) == ids


def test_short_terms_never_go_to_fts(corpus):
    speech, meeting = corpus
    assert S.hits(speech, meeting, S.Options(), Plan("fts", terms=(W,))).count() == 0


def test_bundle(corpus, spark):
    speech, meeting = corpus
    df = spark.createDataFrame([("ＡＩ", 2), ("憲法", 7)], "term string, n_speeches long")
    got = S.search_bundle("ai 憲法", speech, meeting, df, S.Options())
    assert (got["query"], got["unsearchable"], got["plan"].driver, got["count"].first().n) == ("ＡＩ 憲法", [], "ＡＩ", 1)
    none = S.search_bundle("踏ま", speech, meeting, df, S.Options())
    assert none["unsearchable"] == ["踏ま"] and none["count"].first().n == 0


def test_context(corpus):
    speech, _ = corpus
    sides = {r.speech_order: r.side for r in S.context(speech, "B", 8, 2).collect()}
    assert sides == {6: "before", 7: "before", 8: "self", 9: "after", 10: "after"}
    assert {r.speech_order for r in S.context(speech, "A", 1).collect()} == {1, 2, 3, 4}
    assert [r.rowid for r in S.timeline(speech, 3, S.Options()).collect()] == [14, 12]


@pytest.mark.parametrize("shape, limit", [({f"202{y}H{h}": range(1, 6) for y in (5, 6) for h in (1, 2)}, 3), ({"2026H2": range(1, 20), "2026H1": range(1, 41)}, 20), ({"2026H2": range(1, 21), "2026H1": range(1, 6)}, 20), ({"2026H2": [3, 1], "2026H1": [], "2025H2": range(1, 30), "2025H1": [9], "2024H1": []}, 7), ({"2026H1": [1, 2]}, 1)])
def test_pages_walk_everything_once(spark, shape, limit):
    rows = [(p, i, "語語語", "議員", dt.date(2026, 1, 1), 1, f"{p}{i}") for p, ids in shape.items() for i in ids]
    random.Random(1).shuffle(rows)
    speech = spark.createDataFrame(rows, "period string, rowid long, body string, speaker_kind string, date date, politician_id int, issue_id string").coalesce(1).cache()
    meeting = spark.createDataFrame([], "issue_id string, name string")
    periods, before, seen, done = sorted(shape, reverse=True), {}, [], False
    while not done:
        page = S.search_page(speech, meeting, periods, S.Options(limit=limit, before=before), Plan("fts", terms=("語語語",)))
        assert len(page.rows) == limit or page.done
        seen, before, done = seen + page.rows, page.before, page.done
    assert seen == sorted(((p, i) for p, ids in shape.items() for i in ids), reverse=True)


def test_cursors():
    assert S.merge_cursors(["b", "a"], [("b", 5), ("b", 4)], {"b": 2, "a": 2}, 2, {}) == ({"b": 4}, False)
    assert S.merge_cursors(["b", "a"], [("b", 5)], {"b": 1, "a": 0}, 2, {}) == ({"b": 0, "a": 0}, True)
    assert S.merge_cursors(["b"], [], {"b": 0}, 2, {"b": 0}) == ({"b": 0}, True)


def test_row_numbers(spark):
    r = random.Random(2)
    rows = [(i, f"i{r.randrange(9)}", r.randrange(50), dt.date(2026, r.randrange(1, 13), 1)) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id long, issue_id string, speech_order int, date date").withColumn("period", F.when(F.month("date") <= 6, "2026H1").otherwise("2026H2"))
    got = {(x.period, x.rowid): x.row_id for x in number_in_periods(df).collect()}
    for p in ("2026H1", "2026H2"):
        own = sorted((x for x in rows if ("2026H1" if x[3].month <= 6 else "2026H2") == p), key=lambda x: (x[3], x[1], x[2], x[0]))
        assert [got[(p, k + 1)] for k in range(len(own))] == [x[0] for x in own]
