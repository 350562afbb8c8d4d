"""Intervals, as-of versions and histories against brute force, and their edge cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from speechmill.operators.asof import version_join
from speechmill.operators.history import snapshot_events, versions
from speechmill.operators.intervals import interval_spans

D = dt.date
LAST = D(9999, 12, 31)
AFFILIATION = "id int, politician_id int, kaiha string, start_date date, end_date date, recorded_at timestamp_ntz, entity string, first int"


def brute_spans(rows):
    """By days: what each day holds, clipped to a window that covers all finite dates."""
    out = set()
    by = {}
    for p, kaiha, a, b in rows:
        if p is not None and a is not None and (b or LAST) >= a:
            by.setdefault(p, []).append((a, b or LAST, kaiha))
    for p, own in by.items():
        cuts = sorted({a for a, _, _ in own} | {b + dt.timedelta(1) for _, b, _ in own if b < LAST})
        pieces = [(a, (cuts[i + 1] - dt.timedelta(1)) if i + 1 < len(cuts) else LAST) for i, a in enumerate(cuts)]

        def runs(test):
            found = []
            for a, b in pieces:
                if test([k for x, y, k in own if x <= a and b <= y]):
                    if found and found[-1][1] + dt.timedelta(1) == a:
                        found[-1] = (found[-1][0], b)
                    else:
                        found.append((a, b))
            return found

        periods = runs(lambda ks: len(ks) > 0)
        doubles = runs(lambda ks: len({k for k in ks if k is not None}) > 1)
        gaps = [(x[1] + dt.timedelta(1), y[0] - dt.timedelta(1)) for x, y in zip(periods, periods[1:])]
        out |= {(p, kind, a.isoformat(), b.isoformat()) for kind, rs in (("period", periods), ("gap", gaps), ("double", doubles)) for a, b in rs}
    return out


def spans(spark, rows):
    df = spark.createDataFrame([(i, p, k, a, b, None, "x", 1) for i, (p, k, a, b) in enumerate(rows)], AFFILIATION)
    found = interval_spans(df, "politician_id", "start_date", "end_date", "kaiha").collect()
    assert len(found) == len(set(found))
    return {tuple(r) for r in found}


def test_spans_random(spark):
    r = random.Random(5)
    rows = []
    for _ in range(400):
        a = D(1950, 1, 1) + dt.timedelta(r.randrange(40_000 if r.random() < 0.1 else 700))
        b = a + dt.timedelta(r.choice([0, 1, 3, 60, 64, 200, 5000, 300_000]) - (5 if r.random() < 0.05 else 0))
        rows.append((r.randrange(30), r.choice(["a", "b", "c", None]), a if r.random() > 0.03 else None, b if r.random() > 0.1 else None))
    assert spans(spark, rows) == brute_spans(rows)


@pytest.mark.parametrize("rows", [
    [],
    [(1, "a", D(2020, 1, 1), D(2020, 1, 1))],
    [(None, "a", D(2020, 1, 1), None), (1, None, None, D(2020, 1, 1)), (1, "a", D(2020, 2, 2), D(2020, 2, 1))],
    [(1, "a", D(2020, 1, 1), D(2020, 1, 31)), (1, "b", D(2020, 2, 1), None), (1, "b", D(2020, 2, 1), None), (1, None, D(2020, 1, 10), D(2020, 3, 1))],
    [(1, "a", D(1, 1, 1), LAST), (1, "b", D(9999, 12, 31), LAST), (2, "a", D(1970, 1, 1), D(1970, 3, 5)), (2, "b", D(1970, 3, 5), D(1970, 3, 6))],
])
def test_spans_edges(spark, rows):
    assert spans(spark, rows) == brute_spans(rows)


def brute_held(events, rows):
    out = set()
    for e, p, d in events:
        fits = [(a, k, i) for i, q, a, b, k in rows if p is not None and d is not None and q == p and a is not None and k is not None and a <= d and (b is None or b >= d) and k.date() <= d]
        if fits:
            out.add((e, max(fits)[2]))
    return out


def test_version_join_random(spark):
    r = random.Random(3)
    day = lambda n: D(2020, 1, 1) + dt.timedelta(r.randrange(n))
    rows = []
    for i in range(300):
        a = day(300) if r.random() > 0.05 else None
        rows.append((i, r.choice([1, 1, 1, 2, 3, None]), a, None if r.random() < 0.2 else day(400), dt.datetime.combine(day(350), dt.time(r.randrange(24))) if r.random() > 0.03 else None))
    events = [(e, r.choice([1, 1, 2, 3, 4, None]), day(400) if r.random() > 0.02 else None) for e in range(800)] + [(7, 1, D(2020, 6, 1))] * 3
    left = spark.createDataFrame(events, "row_id long, politician_id int, date date")
    right = spark.createDataFrame(rows, "id int, politician_id int, start_date date, end_date date, recorded_at timestamp_ntz").withColumns({"party": F.concat(F.lit("p"), "id"), "date": F.lit("clash"), "entity": F.lit("clash"), "version": F.lit(0)})
    found = version_join(left, "row_id", "politician_id", "date", right, "id", "politician_id", "start_date", "end_date", "recorded_at", ["party"]).collect()
    assert {(x.row_id, x.id) for x in found} == brute_held(events, rows)
    assert all(x.party == f"p{x.id}" for x in found)
    assert sum(x.row_id == 7 for x in found) >= 3 or not any(x.row_id == 7 for x in found)


def test_version_join_empty(spark):
    left = spark.createDataFrame([], "row_id long, politician_id int, date date")
    right = spark.createDataFrame([], "id int, politician_id int, start_date date, end_date date, recorded_at timestamp_ntz")
    assert version_join(left, "row_id", "politician_id", "date", right, "id", "politician_id", "start_date", "end_date", "recorded_at").count() == 0


def brute_versions(rows):
    best = {}
    for s, d, p, k, party, at in rows:
        if p is not None and d is not None and ((p, d) not in best or (at, s) > best[(p, d)][0]):
            best[(p, d)] = ((at, s), (k, party))
    out = set()
    for p in {p for p, _ in best}:
        kept = []
        for d in sorted(d for q, d in best if q == p):
            state = best[(p, d)][1]
            if not kept or kept[-1][1] != state:
                kept.append((d, state))
        out |= {(p, d.isoformat(), (kept[i + 1][0] - dt.timedelta(1)).isoformat() if i + 1 < len(kept) else "9999-12-31") for i, (d, _) in enumerate(kept)}
    return out


def test_versions_random(spark):
    r = random.Random(9)
    ends = [D(2021, 3, 31), D(2021, 6, 30), D(2021, 9, 30), D(2021, 12, 31), D(2022, 3, 31)]
    rows = [(s, r.choice([*ends, None]), r.choice([1, 1, 2, 3, 4, None]), r.choice(["a", "b", None]), r.choice(["x", None]), dt.datetime(2022, 5, r.randrange(1, 20))) for s in range(120)]
    df = spark.createDataFrame(rows, "snap_id long, day date, who int, kaiha string, party string, loaded_at timestamp_ntz").withColumn("state", F.lit(1)).withColumn("seq", F.lit(1))
    found = versions(df, "who", "day", {"kaiha": F.col("kaiha"), "party": F.col("party")}, "loaded_at", "snap_id").collect()
    assert {(x.entity, x.valid_from, x.valid_to) for x in found} == brute_versions(rows)
    assert versions(df.limit(0), "who", "day", {"kaiha": F.col("kaiha")}, "loaded_at", "snap_id").count() == 0


def test_snapshot_events(spark):
    rows = [(1, D(2021, 3, 31), 1, "a"), (2, D(2021, 6, 30), 2, "b"), (3, D(2021, 9, 30), 1, "a"), (4, D(2021, 9, 30), 2, "c")]
    df = spark.createDataFrame(rows, "snap_id int, day date, who int, kaiha string")
    found = {(x.entity, x.seq, x.kind) for x in snapshot_events(df, "who", "day", {"kaiha": F.col("kaiha")}, "snap_id", "snap_id").collect()}
    assert found == {(1, 1, "inserted"), (1, 2, "deleted"), (2, 2, "inserted"), (1, 3, "inserted"), (2, 3, "changed"), (1, 4, "deleted"), (2, 4, "deleted")}


def test_same_look(spark):
    from speechmill.functions.text import same_look

    values = ["　青雲・ＮＥＸＴ", "青雲･NEXT ", "青​雲・ＮＥＸＴ\xa0"]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v string").select(same_look(F.col("v")).alias("v"))
    assert {r.v for r in df.collect()} == {"青雲・ＮＥＸＴ", None}
