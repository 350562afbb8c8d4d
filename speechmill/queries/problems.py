"""Queries of the general data problems, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import version_join
from ..operators.history import affiliation_history
from ..operators.intervals import interval_spans
from ..session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = interval_spans(table(spark, sf_dir, "affiliation"), "politician_id", "start_date", "end_date", "kaiha")
    return spans.withColumnRenamed("entity", "politician_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    speech, rows = table(spark, sf_dir, "speech"), table(spark, sf_dir, "affiliation")
    held = version_join(speech, "row_id", "politician_id", "date", rows, "id", "politician_id", "start_date", "end_date", "recorded_at")
    return held.select("row_id", F.col("id").cast("long").alias("affiliation_id"))


def p3_speech_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each speech with the affiliation's wide attributes joined by version number."""
    speech, rows = table(spark, sf_dir, "speech"), table(spark, sf_dir, "affiliation")
    held = version_join(speech, "row_id", "politician_id", "date", rows, "id", "politician_id", "start_date", "end_date", "recorded_at", ["kaiha", "party"])
    return held.select("row_id", F.col("id").cast("long").alias("affiliation_id"), "kaiha", "party")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = affiliation_history(table(spark, sf_dir, "affil_snapshot"))
    return versions.select(F.col("entity").alias("politician_id"), "valid_from", "valid_to")


def p6_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return affiliation_history(table(spark, sf_dir, "affil_snapshot")).withColumnRenamed("entity", "politician_id")


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_speech_party": p3_speech_party, "p6_found": p6_found, "p6_history": p6_history}

_HELD = """
WITH pairs AS (
    SELECT s.row_id, a.id AS affiliation_id, a.kaiha, a.party,
        row_number() OVER (PARTITION BY s.row_id ORDER BY a.start_date DESC, a.recorded_at DESC, a.id DESC) AS n
    FROM speech s JOIN affiliation a ON a.politician_id = s.politician_id
        AND a.start_date <= s.date AND (a.end_date IS NULL OR a.end_date >= s.date) AND CAST(a.recorded_at AS DATE) <= s.date)
SELECT row_id, CAST(affiliation_id AS BIGINT) AS affiliation_id{more} FROM pairs WHERE n = 1"""

_SAME_LOOK = "trim(translate(regexp_replace(kaiha, '[' || chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(65279) || chr(173) || chr(6158) || ']', '', 'g'), '･ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 ' || chr(160), '・ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９' || chr(12288) || chr(12288)), chr(12288))"

_HISTORY = f"""
WITH picked AS (
    SELECT politician_id, snapshot_date, {_SAME_LOOK} AS kaiha, party,
        row_number() OVER (PARTITION BY politician_id, snapshot_date ORDER BY loaded_at DESC, snap_id DESC) AS n
    FROM affil_snapshot WHERE politician_id IS NOT NULL AND snapshot_date IS NOT NULL),
    lagged AS (
    SELECT *, lag(kaiha) OVER w AS old_kaiha, lag(party) OVER w AS old_party, row_number() OVER w AS k
    FROM picked WHERE n = 1 WINDOW w AS (PARTITION BY politician_id ORDER BY snapshot_date)),
    kept AS (SELECT * FROM lagged WHERE k = 1 OR kaiha IS DISTINCT FROM old_kaiha OR party IS DISTINCT FROM old_party)
SELECT CAST(politician_id AS BIGINT) AS politician_id{{more}}, strftime(snapshot_date, '%Y-%m-%d') AS valid_from,
    coalesce(strftime(lead(snapshot_date) OVER (PARTITION BY politician_id ORDER BY snapshot_date) - INTERVAL 1 DAY, '%Y-%m-%d'), '9999-12-31') AS valid_to
FROM kept"""

ORACLES = {
    "p2_found": """
WITH rows AS (
    SELECT politician_id, kaiha, start_date AS a, coalesce(end_date, DATE '9999-12-31') AS b FROM affiliation
    WHERE politician_id IS NOT NULL AND start_date IS NOT NULL AND coalesce(end_date, DATE '9999-12-31') >= start_date),
    islands AS (
    SELECT politician_id, a, b, CASE WHEN a - max(b) OVER w <= 1 THEN 0 ELSE 1 END AS fresh
    FROM (SELECT DISTINCT politician_id, a, b FROM rows) WINDOW w AS (PARTITION BY politician_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY politician_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM islands),
    periods AS (SELECT politician_id, island, min(a) AS a, max(b) AS b FROM numbered GROUP BY ALL),
    gaps AS (SELECT p.politician_id, CAST(p.b + INTERVAL 1 DAY AS DATE) AS a, lead(p.a) OVER (PARTITION BY p.politician_id ORDER BY p.a) - 1 AS b FROM periods p),
    edges AS (SELECT politician_id, a AS day FROM rows UNION SELECT politician_id, CAST(b + INTERVAL 1 DAY AS DATE) FROM rows WHERE b < DATE '9999-12-31' UNION SELECT DISTINCT politician_id, DATE '9999-12-31' FROM rows),
    stretches AS (SELECT politician_id, day AS a, coalesce(CAST(lead(day) OVER (PARTITION BY politician_id ORDER BY day) - INTERVAL 1 DAY AS DATE), DATE '9999-12-31') AS b FROM edges),
    deep AS (
    SELECT s.politician_id, s.a, s.b FROM stretches s JOIN rows r ON r.politician_id = s.politician_id AND r.a <= s.a AND r.b >= s.b
    GROUP BY ALL HAVING count(DISTINCT r.kaiha) >= 2),
    deep2 AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY politician_id ORDER BY a) = 1 THEN 0 ELSE 1 END AS fresh FROM deep),
    deep3 AS (SELECT *, sum(fresh) OVER (PARTITION BY politician_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS island FROM deep2),
    doubles AS (SELECT politician_id, island, min(a) AS a, max(b) AS b FROM deep3 GROUP BY ALL),
    spans AS (
    SELECT politician_id, 'period' AS span_kind, a, b FROM periods
    UNION ALL SELECT politician_id, 'gap', a, b FROM gaps WHERE b IS NOT NULL
    UNION ALL SELECT politician_id, 'double', a, b FROM doubles)
SELECT CAST(politician_id AS BIGINT) AS politician_id, span_kind, strftime(a, '%Y-%m-%d') AS from_date, strftime(b, '%Y-%m-%d') AS to_date FROM spans""",
    "p3_found": _HELD.format(more=""),
    "p3_speech_party": _HELD.format(more=", kaiha, party"),
    "p6_found": _HISTORY.format(more=""),
    "p6_history": _HISTORY.format(more=", kaiha, party"),
}
