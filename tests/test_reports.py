"""Overrides and reports."""

import json

from pyspark.sql import functions as F

from speechmill.functions import text as X
from speechmill.operators import entity as E
from speechmill.operators import ranking as R
from speechmill.sources.reports import write_report


def test_overrides(spark):
    data = {"Q1": {"甲": "A", "乙": None, "丙": {"periods": [{"until": "2022-01-01", "party": "A"}, {"party": None}]}}, "Q2": {"甲": {"party": "B"}, "乙": {"periods": [{"party": None}]}}}
    rows = E.override_rows(data)
    assert rows == [("Q1", "甲", 1, None, None, "A"), ("Q1", "丙", 1, None, "2022-01-01", "A"), ("Q1", "丙", 2, None, None, None), ("Q2", "甲", 1, None, None, "B")]
    filled = spark.createDataFrame(rows, "person_key string, kaiha string, seq int, f string, u string, party string")
    todo = spark.createDataFrame([("Q1", "乙"), ("Q1", "甲"), ("Q1", "乙")], "person_key string, kaiha string")
    assert [tuple(r) for r in E.override_slots(todo, filled).collect()] == [("Q1", "丙", True), ("Q1", "乙", False), ("Q1", "甲", True), ("Q2", "甲", True)]


def test_report(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "term string, n int").coalesce(1)
    write_report(df, str(tmp_path / "r.md"), "語", titles={"term": "語"})
    assert (tmp_path / "r.md").read_text(encoding="utf-8") == "# 語\n\n| 語 | n |\n|---|---|\n| a\\|b | 1 |\n|  | 2 |\n"


def test_profile(spark):
    df = spark.createDataFrame([("a ", None), (" 　", "x"), (None, "x")], "a string, b string")
    assert {r.field: r.missing_percent for r in R.missing_shares(df).collect()} == {"a": 33.3, "b": 33.3}
    assert [(r.value, r.n) for r in R.top_values(df, "b", 1).collect()] == [("x", 2)]
    assert {r.field: r.n for r in R.odd_blanks(df, ["a", "b"]).collect()} == {"a": 2, "b": 0}
    assert R.missing_shares(df.limit(0)).count() == 2


def test_small_functions(spark):
    row = spark.range(1).select(X.rate(F.lit(5), F.lit(0)).alias("zero"), X.rate(F.lit(5), F.lit(1000)).alias("five"), X.json_script(F.lit('{"a":"</b>"}')).alias("j"), X.fingerprint(F.array(F.lit("a"), F.lit("b"))).alias("fp")).first()
    assert (row.zero, row.five, row.j) == (0.0, 5.0, '{"a":"\\u003c/b>"}') and len(row.fp) == 16


def test_topic_lists(spark):
    from speechmill.operators.postings import overlapping_forms, topic_changes, topic_problems, topic_table

    topics = [{"id": 1, "term": "年金", "variants": ["年金制度"]}, {"id": 2, "term": "お金", "variants": ["年金"]}, {"id": 2, "term": "道路"}, {"id": 9, "term": "鉄道"}]
    listed, retired = topic_table(spark, topics), spark.createDataFrame([(9,)], "id int")
    got = {tuple(r) for r in topic_problems(listed, retired).collect()}
    assert got == {(2, "年金 also in 1"), (2, "term can't be searched"), (2, "id used twice"), (9, "id was retired"), (1, "年金 lies inside 年金制度"), (2, "年金 lies inside 年金制度 of 1")}
    assert overlapping_forms(topic_table(spark, topics[2:])).count() == 0
    changed = topic_changes(topic_table(spark, topics[:2]), topic_table(spark, [topics[0], {"id": 2, "term": "現金"}, topics[3]]))
    assert {tuple(r) for r in changed.collect()} == {(9, "added"), (2, "changed")}


def test_knowledge_base(spark, tmp_path):
    from speechmill.sources import records as R

    (tmp_path / "persons.json").write_text('{"id":"Q1","name":"","house":"衆議院","party":"甲"}\n{"id":"Q1","name":"鮫松","kana":"さめまつ","house":"衆議院","party":"乙"}\n{"id":"Q2"}\n{"name":"x"}\n', encoding="utf-8")
    (tmp_path / "terms.json").write_text('{"id":"Q1","house":"衆議院","start":"2021-01-01T00:00:00Z","end":"2020-01-01"}\n' * 2, encoding="utf-8")
    members, terms = R.read_knowledge_base(spark, str(tmp_path))
    got = {r.wikidata_id: (r.name, r.kana, r.houses, r.parties) for r in members.collect()}
    assert got == {"Q1": ("鮫松", "さめまつ", ["衆議院"], ["甲", "乙"]), "Q2": (None, None, [], [])}
    assert [(r.wikidata_id, r.start.isoformat(), r.end.isoformat(), r.district) for r in terms.collect()] == [("Q1", "2021-01-01", "2020-01-01", None)]
    assert {tuple(r) for r in R.kb_problems(members, terms).collect()} == {("Q2", "no name"), ("Q2", "no reading"), ("Q2", "no party"), ("Q1", "term ends before it starts")}


def test_a_failing_month_does_not_stop_the_rest(tmp_path):
    from speechmill.sources import records as R

    def get(query):
        if query["from"] == "2025-02-01":
            raise OSError("out of order")
        if query["from"] == "2025-03-01":
            return {"numberOfRecords": 0}
        return {"numberOfRecords": 1, "speechRecord": [{"speechID": query["from"]}]}

    queries = {f"2025-0{m}": {"from": f"2025-0{m}-01"} for m in (4, 2, 3, 1)}
    assert R.resume_months(get, queries, tmp_path, sleep=lambda _: None) == [("2025-01", "done"), ("2025-02", "failed: out of order"), ("2025-03", "empty"), ("2025-04", "done")]
    assert R.resume_months(get, queries, tmp_path, sleep=lambda _: None)[0] == ("2025-01", "skip")


def test_a_getter_can_be_named(spark, monkeypatch, tmp_path):
    from speechmill.sources import records as R

    (tmp_path / "named_getter.py").write_text("def answers(query):\n    at = query['startRecord']\n    return {'speechRecord': [{'speechID': f's{at}'}], 'nextRecordPosition': at + 1 if at < 3 else None}\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    reader = R.PagedReader({"getter": "named_getter:answers", "pause": "0"})
    assert [r[R.RAW.names.index("speechID")] for r in reader.read(reader.partitions()[0])] == ["s1", "s2", "s3"]


def test_daily_counts_follow_corrections(spark, tmp_path):
    import datetime as dt

    from speechmill.streaming import ingest as I

    folder, table, daily = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "d")
    folder.mkdir()
    raw = lambda i, day, text: {"issueID": f"m{day}", "speechID": f"s{i}", "date": day, "speechOrder": i, "speaker": "甲", "speakerYomi": "こう", "speech": text}
    write = lambda name, rows: (folder / name).write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")
    write("a.ndjson", [raw(1, "2025-11-05", "年金と年金"), raw(2, "2026-01-05", "道路"), raw(3, "2026-01-06", "年金")])
    I.start_ingest(spark, str(folder), table, str(tmp_path / "c"), daily).awaitTermination()
    write("b.ndjson", [raw(1, "2026-01-06", "年金")])
    I.start_ingest(spark, str(folder), table, str(tmp_path / "c"), daily).awaitTermination()
    got = {(r.window, r.from_date, r.until, r.sitting_days, r.n_speeches, r.term, r.n) for r in I.sitting_windows(spark.read.parquet(daily), days=1).collect()}
    assert got == {(0, dt.date(2026, 1, 6), dt.date(2026, 1, 6), 1, 2, "年金", 2), (1, dt.date(2026, 1, 5), dt.date(2026, 1, 5), 1, 1, "道路", 1)}


def test_reports_are_set_in_order(spark, tmp_path):
    from speechmill.sources import products as P

    rows = spark.createDataFrame([("年金|制度", 3), ("道路", 5)], "term string, n long")
    lines = P.report_lines("題", [("一", "注", rows, [F.desc("n")]), ("二", "", rows.limit(0), [F.desc("n")])])
    P.save_report(lines, str(tmp_path / "r"))
    text = spark.read.text(str(tmp_path / "r")).collect()
    assert [r.value for r in text] == ["# 題", "## 一", "注", "| term | n |", "|---|---|", "| 道路 | 5 |", "| 年金\\|制度 | 3 |", "## 二", "| term | n |", "|---|---|"]
    P.save_product(rows, str(tmp_path / "p"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "p")).collect()) == ['{"term":"年金|制度","n":3}', '{"term":"道路","n":5}']
