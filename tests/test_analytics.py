"""Mining, series, entities, checks, sources and the stream on small fixtures."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from speechmill.operators import activity as A
from speechmill.operators import entity as E
from speechmill.operators import facts as FA
from speechmill.operators import mining as M
from speechmill.operators import quality as Q
from speechmill.operators import series as T
from speechmill.sources import records as R
from speechmill.streaming import ingest as I

D = dt.date


def test_session_lift(spark):
    words = spark.createDataFrame([("裏金", 100), ("国民", 1000), ("零", 0)], "term string, n long")
    sessions = spark.createDataFrame([(213, 1000), (217, 2000)], "session int, n_speeches long")
    hits = spark.createDataFrame([("裏金", 213, 60), ("国民", 213, 100), ("国民", 217, 29), ("零", 213, 40), ("裏金", 999, 40)], "term string, session int, hits long")
    got = [(r.session, r.term, r.rank, round(r.lift, 6)) for r in T.session_lift(hits, sessions, words, 10_000).orderBy("session", "rank").collect()]
    assert got == [(213, "裏金", 1, 6.0), (213, "国民", 2, 1.0)]


def test_rates(spark):
    cells = spark.createDataFrame([(1, "2025-01", "*", 68), (1, "2025-04", "*", 706), (1, "2025-05", "*", 3)], "topic_id int, month string, kaiha string, n_speeches long")
    totals = spark.createDataFrame([("2025-01", "*", 908), ("2025-04", "*", 19739)], "month string, kaiha string, total long")
    assert {r.month: round(r.rate, 1) for r in T.rates(cells, totals).collect()} == {"2025-01": 74.9, "2025-04": 35.8}
    assert {r.month: round(r.rate, 1) for r in T.rates(cells, totals, True).collect()}["2025-05"] == 0
    monthly = cells.select("month", F.col("n_speeches").alias("n"))
    assert {r.mode for r in T.trend_mode(monthly, totals.drop("kaiha")).collect()} == {"count"}
    assert {r.mode for r in T.trend_mode(monthly.where("month < '2025-05'"), totals.drop("kaiha")).collect()} == {"rate"}


def test_bursts_use_the_upper_median_and_the_first_peak(spark):
    profile = M.yearly(spark.createDataFrame([("語", "2021", 4), ("語", "2023", 4)], "term string, year string, n long"), {"2021": 1000.0, "2022": 1000.0, "2023": 1000.0, "2024": 1000.0}, 1000)
    got = M.bursts(profile, ["2021", "2022", "2023", "2024"]).first()
    assert (round(got.burst, 6), got.peak_year, got.peak_n, round(got.recency, 6)) == (1.0, "2021", 4, round(0.1 / 4.1, 6))


def test_near_duplicates(spark):
    df = spark.createDataFrame([("変異", 100), ("変異株", 80), ("陽性", 1248), ("陽性者", 651)], "term string, n long")
    assert [r.term for r in M.near_duplicates(df, 0.75).collect()] == ["変異"]


def test_words_without_names(spark):
    speech = spark.createDataFrame([("高市早苗",), (None,)], "speaker string")
    terms = spark.createDataFrame([(t,) for t in ("高市", "高市総理", "年金", "令和八年度予算", "委員会", "早苗君", "議長", "地方自治")], "term string")
    assert {r.term for r in M.keep_words(terms, speech, ["地方自治"]).collect()} == {"年金"}
    noise = spark.createDataFrame([(t,) for t in ("三十", "五月八日", "御指摘", "資料", "道路")], "term string")
    assert [r.term for r in noise.where(M.no_noise(F.col("term"))).collect()] == ["道路"]


def test_empty_corpus(spark):
    speech = spark.createDataFrame([], "period string, rowid long, date date, issue_id string, body string, speaker string, speaker_group string, politician_id int")
    meeting = spark.createDataFrame([], "issue_id string, session int, name string")
    assert M.standing_terms(speech).count() == M.frequencies(speech, meeting, M.pool(M.standing_terms(speech))).count() == 0
    assert M.trend_windows(speech, speech).count() == T.topic_cells(speech, [{"id": 1, "term": "x"}]).count() == A.activity(speech, meeting).count() == 0


def test_fold_small(spark):
    cells = spark.createDataFrame([(1, "a", "m", 5), (1, "b", "m", 3), (1, "c", "m", 3), (2, "a", "m", 1)], "p int, name string, month string, n long")
    assert {tuple(r) for r in A.fold_small(cells, "p", "name", "n", 2).select("p", "name", "n").collect()} == {(1, "a", 5), (1, "b", 3), (1, "その他", 3), (2, "a", 1)}


def test_classify(spark):
    rows = [("会議録情報", None, None), ("甲", "参考人", "よみ"), ("乙", None, "よみ"), ("丙", None, None), (None, None, "")]
    df = spark.createDataFrame(rows, "s string, r string, y string")
    flag, kind = FA.classify(F.col("s"), F.col("r"), F.col("y"))
    assert [tuple(r) for r in df.select(flag, kind).collect()] == [(0, "非発言"), (1, "参考人"), (1, "議員"), (1, "政府参考人等"), (1, "政府参考人等")]


def test_latest_rows(spark):
    df = spark.createDataFrame([("a", 1, 3, "x"), ("a", 2, 2, "y"), ("a", 2, 3, "z"), ("a", 2, 3, "z"), ("b", 1, 4, None), (None, 1, 5, "q")], "k string, v int, t int, w string")
    rows, n = FA.latest_rows(df, "k", "v", "t")
    assert (sorted(tuple(r) for r in rows.collect()), n) == ([("a", 2, 3, "z"), ("b", 1, 4, None)], 2)


def test_catalog_and_versions(spark):
    a = spark.createDataFrame([("p", 1), ("p", 2), ("q", None)], "k string, v int")
    b = a.orderBy(F.desc("v"))
    got = {r.k: r.version for r in FA.content_version(a, "k", ["v"]).collect()}
    assert got == {r.k: r.version for r in FA.content_version(b, "k", ["v"]).collect()}
    assert got["p"] != {r.k: r.version for r in FA.content_version(a.where("v = 1 OR k = 'q'"), "k", ["v"]).collect()}["p"]


def test_narrowing(spark):
    unit = "speaker string, speaker_yomi string, speaker_group string, n_speeches long, first_date date, last_date date, houses string"
    day = (D(2022, 1, 1), D(2022, 12, 31))
    found = spark.createDataFrame([("鬼木誠", "おにきまこと", "立憲・無", 5, *day, "参議院"), ("阿部 一", "あべ", "自民", 3, *day, "衆議院"), ("森薫", "もりかおる", None, 2, *day, "衆議院,参議院"), ("無名", "むめい", None, 1, *day, ""), ("谷口幸", None, None, 1, *day, "")], unit)
    members = spark.createDataFrame([("Q1", "鬼木誠", "おにき まこと", ["衆議院"], ["自民党"]), ("Q2", "鬼木誠", "オニキ　マコト", ["参議院"], ["立憲"]), ("Q3", "阿部一", "あべ", [], []), ("Q4", "安倍二", "あべ", [], []), ("Q5", "森香", "もりかおる", ["衆議院"], []), ("Q6", "森馨", "もりかおる", ["参議院"], []), ("Q7", "谷口幸", None, [], [])], "wikidata_id string, name string, kana string, houses array<string>, parties array<string>")
    terms = spark.createDataFrame([("Q5", D(2015, 1, 1), D(2018, 1, 1)), ("Q6", D(2021, 1, 1), None)], "wikidata_id string, start date, end date")
    pm = spark.createDataFrame([("立憲・無", ["立憲"])], "kaiha string, parties array<string>")
    got = {r.speaker: (r.route, r.narrowed_by, r.n_candidates, r.wikidata_id) for r in E.match_units(found, members, terms, pm).collect()}
    assert got == {"鬼木誠": ("reading", "party", 1, "Q2"), "阿部 一": ("reading", "exact name", 1, "Q3"), "森薫": ("reading", "term", 1, "Q6"), "無名": ("none", None, 0, None), "谷口幸": ("name", None, 1, "Q7")}


def given_one_by_one(people, keys):
    """What assign_ids gives, person by person."""
    keys, told = dict(keys), {i: k for k, i in keys.items() if k[:6] != "local:"}
    out, free = {}, max([0, *keys.values()]) + 1
    for person, qid, local in people:
        got = keys.get(qid)
        if got is None and local in keys and keys[local] not in told:
            got = keys[local]
        if got is None:
            got, free = free, free + 1
        if qid:
            keys[qid], told[got] = got, qid
        keys.setdefault(local, got)
        out[person] = got
    return out, keys


def assigned(spark, people, keys):
    df = spark.createDataFrame([(p, q, l, i) for i, (p, q, l) in enumerate(people, 1)], "person_key string, wikidata_id string, local string, seq int")
    known = spark.createDataFrame(list(keys.items()), "key string, id long")
    rows = E.assign_ids(df, known)
    return {r.person_key: r.id for r in rows.collect()}, {r.key: r.id for r in E.ledger(rows, known).collect()}


def test_ledger(spark):
    people = [("a", "Q1", "local:鬼木誠:おにき"), ("b", "Q2", "local:鬼木誠:おにき"), ("c", None, "local:新人:しん"), ("d", "Q3", "local:新人:しん")]
    ids, keys = assigned(spark, people, {})
    assert ids == {"a": 1, "b": 2, "c": 3, "d": 3} and keys == {"Q1": 1, "Q2": 2, "Q3": 3, "local:鬼木誠:おにき": 1, "local:新人:しん": 3}
    assert assigned(spark, [("a", "Q1", "local:別名:べつ"), ("b", "Q2", "local:x"), ("e", None, "local:四:よ")], keys)[0] == {"a": 1, "b": 2, "e": 4}


def test_ledger_against_one_by_one(spark):
    r = random.Random(3)
    keys = {}
    for _ in range(4):
        people = [(f"Q{q}", f"Q{q}", f"local:{r.randrange(9)}") for q in r.sample(range(20), 9)] + [(f"local:{k}", None, f"local:{k}") for k in r.sample(range(9), 5)]
        r.shuffle(people)
        want = given_one_by_one(people, keys)
        assert assigned(spark, people, keys) == want
        keys = want[1]


def test_speeches_of_units(spark, monkeypatch):
    units = spark.createDataFrame([("甲", None, "一", 1), (None, "甲", "一", 2), ("甲", "こう", None, 3)], "speaker string, speaker_yomi string, speaker_group string, person_id long")
    speech = spark.createDataFrame([(i, f"s{i}", *u) for i, u in enumerate([("甲", None, "一"), (None, "甲", "一"), ("甲", "こう", None), ("甲", "こう", "一"), (None, None, None)])], "row_id long, speech_id string, speaker string, speaker_yomi string, speaker_group string")
    for small in (True, False):
        monkeypatch.setattr(E, "small_enough", lambda *_, small=small: small)
        assert {r.row_id: r.person_id for r in E.assign_speeches(speech, units).collect()} == {0: 1, 1: 2, 2: 3, 3: None, 4: None}


def test_override_checks_and_sync(spark):
    parts = [("p", "一", 1, None, D(2022, 1, 1), "甲"), ("p", "一", 2, D(2021, 1, 1), None, "無い党"), ("q", "二", 1, None, None, None), ("r", "三", 1, None, None, "甲"), ("r", "三", 2, D(2022, 1, 1), D(2021, 1, 1), None)]
    overrides = spark.createDataFrame(parts, "person_key string, kaiha string, seq int, from_date date, until date, party string")
    pairs = spark.createDataFrame([("p", "一"), ("q", "二"), ("s", "四")], "person_key string, kaiha string")
    got = {tuple(x) for x in E.override_problems(overrides, pairs, spark.createDataFrame([("甲",)], "party string")).collect()}
    assert got == {("p", "一", "unknown party"), ("p", "一", "begins before the last part ends"), ("r", "三", "no such pair"), ("r", "三", "no end before the last part"), ("r", "三", "ends before it begins")}
    synced = {(x.person_key, x.seq, x.party) for x in E.override_sync(overrides, pairs.where("person_key <> 'q'")).collect()}
    assert synced == {("p", 1, "甲"), ("p", 2, "無い党"), ("r", 1, "甲"), ("r", 2, None), ("s", 1, None)}


def test_parties(spark):
    pm = spark.createDataFrame([("一", ["甲"]), ("二", ["甲", "乙"]), ("空", [])], "kaiha string, parties array<string>")
    rows = spark.createDataFrame([("一", None, None, None), ("二", "Q1", ["乙"], None), ("二", None, None, None), ("二", "Q1", [], None), ("二", "Q1", ["丙"], None), ("二", "Q1", ["甲", "乙"], None), ("空", "Q1", ["甲"], None), ("空", "Q1", ["甲"], "手"), (None, "Q1", ["甲"], None)], "kaiha string, wikidata_id string, parties array<string>, given string")
    got = [(r.party, r.why) for r in E.resolve_party(rows.withColumn("i", F.monotonically_increasing_id()), pm, "given").orderBy("i").collect()]
    assert got == [("甲", None), ("乙", None), (None, E.UNMATCHED), (None, E.NO_PARTY), (None, E.NO_OVERLAP), (None, E.SEVERAL), (None, E.NO_CANDIDATE), ("手", None), (None, E.NO_CANDIDATE)]


def test_checks(spark):
    facts = spark.createDataFrame([("2026H1", 1, D(2026, 1, 5)), ("2026H1", 2, D(2026, 2, 1)), ("2026H1", 3, D(2026, 1, 9))], "period string, rowid long, date date")
    assert Q.inversions(facts).first().n == 1 and Q.bound_mismatches(facts).count() > 0
    stored = spark.createDataFrame([("a", 2), ("b", 1)], "term string, n_speeches long")
    postings = spark.createDataFrame([("a", "p", 1), ("b", "p", 1), ("c", "p", 2)], "term string, period string, rowid long")
    assert {r.term for r in Q.frequency_mismatches(stored, postings, "term").collect()} == {"a", "c"}
    texts = spark.createDataFrame([("p", 1, "ab"), ("p", 2, "x")], "period string, rowid long, body string")
    assert [r.term for r in Q.false_hits(postings, texts).collect()] == ["c"]
    assert Q.large_enough(facts, 3) and not Q.large_enough(facts, 4)


def raw(i, day, speech, order=1, issue="120100001X00120260105", **more):
    return {"issueID": issue, "speechID": f"{issue}_{i}", "session": 1, "nameOfHouse": "衆議院", "nameOfMeeting": "委員会", "date": day, "speechOrder": order, "speaker": "甲", "speakerYomi": "こう", "speech": speech} | more


def test_facts_from_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/2026-01.ndjson").write_text("\n\n".join(json.dumps(x, ensure_ascii=False) for x in (raw(1, "2026-01-05", "旧"), raw(2, "2026-01-05", "b", 2), raw(3, "2025-12-28", "年末", 3, nameOfMeeting="後の名"))) + "\n", encoding="utf-8")
    (tmp_path / "in/2026-07.ndjson").write_text(json.dumps(raw(1, "2026-01-05", "新"), ensure_ascii=False) + "\n", encoding="utf-8")
    df = R.read_raw(spark, str(tmp_path / "in"))
    stats = {r.period: r.speeches for r in R.build_facts(spark, df, str(tmp_path / "out")).collect()}
    assert stats == {"2025H2": 1, "2026H1": 2}
    got = {r.speech_id[-1]: (r.body, r.rowid, r.speaker_kind) for r in spark.read.parquet(str(tmp_path / "out/speech")).collect()}
    assert got == {"1": ("新", 1, "議員"), "2": ("b", 2, "議員"), "3": ("年末", 1, "議員")}
    assert spark.read.parquet(str(tmp_path / "out/meeting")).first().name == "委員会"
    assert {r.file: r.n for r in R.outside_period(df).collect()} == {"2026-01.ndjson": 1, "2026-07.ndjson": 1}
    assert R.available_periods(spark, str(tmp_path / "in")) == ["2026H2", "2026H1"]
    with pytest.raises(FileNotFoundError):
        R.read_raw(spark, str(tmp_path / "in"), 2019)


class Api:
    """Serves records in pages, failing when told to."""

    def __init__(self, n, fail=()):
        self.records, self.fail, self.calls = [raw(i, "2026-01-05", "x", i) for i in range(1, n + 1)], list(fail), 0

    def __call__(self, query):
        self.calls += 1
        if self.calls in self.fail:
            return {"message": "busy"}
        at, k = query["startRecord"], query["maximumRecords"]
        nxt = at + k
        return {"numberOfRecords": len(self.records), "speechRecord": self.records[at - 1 : nxt - 1], "nextRecordPosition": nxt if nxt <= len(self.records) else None}


def test_pages_and_retries(tmp_path):
    waits = []
    api = Api(250, fail=(2, 3))
    assert len(list(R.pages(api, {"from": "2026-01"}, sleep=waits.append))) == 250
    assert waits[:3] == [3.0, 3.0, 6.0]
    with pytest.raises(ValueError):
        R.fetch_page(api, {"from": ""})
    with pytest.raises(OSError):
        R.fetch_page(Api(1, fail=range(1, 9)), {"from": "x"}, sleep=lambda _: None)
    assert len(list(R.pages(api, {"from": "x"}, limit=120, sleep=lambda _: None))) == 120
    path = tmp_path / "2026-01.ndjson"
    path.with_suffix(".ndjson.part").write_text("".join(json.dumps(x) + "\n" for x in api.records[:130]))
    assert R.resume_month(api, {"from": "x"}, path, sleep=lambda _: None) == "recovered"
    assert R.resume_month(api, {"from": "x"}, path, sleep=lambda _: None) == "skip"
    assert R.resume_month(Api(0), {"from": "x"}, tmp_path / "2026-02.ndjson", sleep=lambda _: None) == "empty"
    assert R.ingest_status(tmp_path, ["2026-01", "2026-03"]) == [("2026-01", "done", 250), ("2026-03", "open", 0)]


def test_data_source(spark, tmp_path):
    api = Api(230)
    for at in (1, 101, 201):
        (tmp_path / f"{at}.json").write_text(json.dumps(api({"startRecord": at, "maximumRecords": 100}), ensure_ascii=False), encoding="utf-8")
    spark.dataSource.register(R.PagedRecords)
    df = spark.read.format("paged_records").option("folder", str(tmp_path)).load()
    assert df.count() == 230 and df.where("speechOrder = 230").first().speaker == "甲"


def test_pipe_table():
    assert R.pipe_table("x\n| a | b |\n|---|:--:|\n| 1 | 2 |\n") == [{"a": "1", "b": "2"}]
    assert R.pipe_table("none") == []


def test_stream_replaces_corrected_speeches(spark, tmp_path):
    folder, table, marks = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    folder.mkdir()
    write = lambda name, rows: (folder / name).write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")
    write("a.ndjson", [raw(1, "2026-01-05", "旧"), raw(2, "2025-11-05", "残")])
    I.start_ingest(spark, str(folder), table, marks).awaitTermination()
    # A correction months later that also moves the speech to another period, and leaves its old one empty.
    write("b.ndjson", [raw(1, "2026-08-05", "新"), raw(3, "2026-09-05", "三")])
    I.start_ingest(spark, str(folder), table, marks).awaitTermination()
    assert {(r.speech_id[-1], r.body, r.period) for r in spark.read.parquet(table).collect()} == {("1", "新", "2026H2"), ("2", "残", "2025H2"), ("3", "三", "2026H2")}
    batch = spark.read.schema(R.RAW).json(str(folder / "b.ndjson"))
    I.upsert(spark, batch, 1, table)
    assert spark.read.parquet(table).count() == 3
    assert I.touched_periods("2026-07-03") == ["2026H2", "2026H1"] and I.touched_periods("2026-05-03") == ["2026H1"] and I.touched_periods("2026-01-01") == ["2026H1", "2025H2"]
    assert I.read_again("2026-01-09") == ["2025-12", "2026-01"]
