"""The build of a store: its tables, manifest, size guard, partial rebuilds and stale readers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from speechmill.plans import search as S
from speechmill.plans.query_text import Plan
from speechmill.sources import build as B

TOPICS = [{"id": 1, "term": "年金", "variants": []}]
ROWS = [
    ("a", 1, "m1", 1, dt.date(2025, 3, 1), "年金の話"), ("a", 2, "m1", 1, dt.date(2025, 3, 1), "年金の話、改"), ("b", 3, "m1", 2, dt.date(2025, 4, 1), "道路の話"), ("c", 4, "m2", 1, dt.date(2025, 9, 1), "年金と道路"),
]


def speeches(spark, rows):
    full = [(s, r, dt.datetime(2026, 1, r), i, o, d, "甲", None, None, b, "議員", f"{d.year}H{1 + (d.month > 6)}") for s, r, i, o, d, b in rows]
    return spark.createDataFrame(full, "speech_id string, row_id long, fetched_at timestamp, issue_id string, speech_order int, date date, speaker string, speaker_group string, politician_id int, body string, speaker_kind string, period string")


def test_store(spark, tmp_path):
    meeting = spark.createDataFrame([("m1", "会", "院", 1), ("m2", "会", "院", 1)], "issue_id string, name string, house string, session int")
    folder = str(tmp_path / "store")
    store = B.build_store(spark, speeches(spark, ROWS), meeting, folder, TOPICS)
    entries = {r.id: (r.meetings, r.speeches, r.indexed, r.hits, r.first_date, r.last_date) for r in store.manifest.collect()}
    assert entries == {"2025H1": (1, 2, 2, 1, "2025-03-01", "2025-04-01"), "2025H2": (1, 1, 1, 1, "2025-09-01", "2025-09-01")}
    assert all(r.size_mb > 0 and len(r.version) == 16 for r in store.manifest.collect())
    total = B.totals(store.manifest).first()
    assert (total.periods, total.speeches, total.hits) == (2, 3, 2)
    found = S.page_hits(store.speech, store.meeting, S.Options(), Plan("word", driver="道路"), TOPICS, store.index)
    assert [(r.period, r.body) for r in found.orderBy("period").collect()] == [("2025H1", "道路の話"), ("2025H2", "年金と道路")]
    seen = spark.createDataFrame(store.manifest.collect(), store.manifest.schema)

    again = B.build_store(spark, speeches(spark, [("c", 4, "m2", 1, dt.date(2025, 9, 1), "年金だけ")]), meeting, folder, TOPICS, ["2025H2"])
    assert {tuple(r) for r in B.stale_periods(seen, again.manifest).collect()} == {("2025H2", "changed")}
    assert again.speech.count() == 3 and S.count_hits(again.speech, again.meeting, S.Options(), Plan("word", driver="道路"), TOPICS, again.index).first().n == 1
    with pytest.raises(ValueError, match="above"):
        B.build_store(spark, speeches(spark, ROWS), meeting, folder, TOPICS, largest_mb=0.0)
    with pytest.raises(ValueError, match="no speeches"):
        B.build_store(spark, speeches(spark, ROWS), meeting, folder, TOPICS, ["2031H1"])
    with pytest.raises(FileNotFoundError):
        B.open_store(spark, str(tmp_path / "none"))


def test_false_topic_hits(spark):
    from speechmill.operators import quality as Q

    facts = spark.createDataFrame([("p", 1, "年金"), ("p", 2, "道路")], "period string, rowid long, body string")
    hits = spark.createDataFrame([("p", 1, 1), ("p", 1, 2), ("p", 9, 1)], "period string, topic_id int, rowid long")
    assert {(r.topic_id, r.rowid) for r in Q.false_topic_hits(hits, facts, TOPICS).collect()} == {(1, 2), (9, 1)}
    holds = F.contains(F.col("body"), F.lit("年金"))
    assert Q.probed_false_hits(facts, facts, holds).count() == 0 and Q.probed_false_hits(facts, facts, holds, 1).count() == 1
