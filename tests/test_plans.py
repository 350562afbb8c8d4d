"""Physical plans: what is pruned, pushed down, broadcast, and never shuffled."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from speechmill import session as N
from speechmill.operators import facts as FA
from speechmill.plans import search as S
from speechmill.plans.query_text import Plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("facts") / "t")
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    rows = [(f"s{i}", "m", i, dt.date(2025 + i % 2, 1, 1), "甲", None, i % 3, "安全保障とデータ", "議員", i, f"{2025 + i % 2}H1") for i in range(20)]
    spark.createDataFrame(rows, "speech_id string, issue_id string, speech_order int, date date, speaker string, speaker_group string, politician_id int, body string, speaker_kind string, rowid long, period string").write.partitionBy("period").parquet(path)
    return spark.read.parquet(path)


def test_search_prunes_and_pushes_down(stored, spark):
    meeting = spark.createDataFrame([("m", "会", "院", 1)], "issue_id string, name string, house string, session int")
    plan = plan_of(S.page(S.hits(stored, meeting, S.Options(periods=("2025H1",), politician=1), Plan("fts", terms=("安全保障",))), S.Options()))
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "2025H1" in scan.split("PartitionFilters")[1].split("PushedFilters")[0] and "EqualTo(politician_id,1)" in scan
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan and "Join" not in plan


def test_count_reads_two_columns(stored, spark):
    meeting = spark.createDataFrame([], "issue_id string, name string")
    plan = plan_of(S.count_by_period(S.hits(stored, meeting, S.Options(), Plan("topic", topic=1), [{"id": 1, "term": "データ"}])))
    assert "ReadSchema: struct<body:string,speaker_kind:string>" in plan and "Contains(body, データ)" in plan.replace("StringContains(body,データ)", "Contains(body, データ)")


def test_impossible_terms_read_nothing(stored, spark):
    meeting = spark.createDataFrame([], "issue_id string, name string")
    assert "FileScan" not in plan_of(S.hits(stored, meeting, S.Options(), Plan("word", driver="踏ま")))


def test_latest_rows_do_not_move_the_texts(stored):
    rows, _ = FA.latest_rows(stored.withColumn("at", F.col("rowid")), "speech_id", "at", "rowid")
    assert "Exchange hashpartitioning" not in plan_of(rows)


def test_beyond_the_bound_latest_rows_are_joined_by_a_shuffle(stored, monkeypatch, spark):
    monkeypatch.setattr(FA, "small_enough", lambda *_: False)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        twice = stored.unionByName(stored.withColumns({"rowid": F.col("rowid") + 100, "body": F.lit("neu")}))
        rows, n = FA.latest_rows(twice, "speech_id", "rowid", "rowid")
        assert "BroadcastHashJoin" not in plan_of(rows) and n == 20 and {r.body for r in rows.collect()} == {"neu"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_bound():
    assert N.small_enough(1000, 100) and not N.small_enough(1 << 20, 100)
