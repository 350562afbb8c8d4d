"""Queries of scalar functions, facts, periods and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import periods as P
from ..functions import text as X
from ..operators import facts as FA
from ..operators import ranking as R
from ..schemas import SPEECH_COLUMNS
from ..session import shared_folder, table
from ..streaming.ingest import start_ingest
from .base import FACTS, facts, meetings, members, sql_fold, sql_hiragana, sql_wide, stats, with_facts


def text_widths(spark, sf_dir):
    p = table(spark, sf_dir, "politician")
    return p.select("id", X.full_width(F.col("official_url")).alias("wide"), X.word_key(X.full_width(F.col("wikidata_id"))).alias("key"), X.to_hiragana(F.col("name_kana")).alias("hiragana"), X.fold(F.col("name_kana")).alias("folded"), F.coalesce(X.is_japanese(F.col("wikidata_name")), F.lit(False)).alias("japanese"))


def text_runs(spark, sf_dir):
    found = X.runs(F.col("body"))
    return members(spark, sf_dir).select("period", "rowid", F.size(found).alias("n"), F.array_join(found, "|").alias("runs"))


def text_occurrences(spark, sf_dir):
    return members(spark, sf_dir).select("period", "rowid", X.occurrences(F.col("body"), F.lit("データ")).alias("n")).where("n > 0")


def text_snippets(spark, sf_dir):
    m = members(spark, sf_dir).where(F.contains("body", F.lit("老朽化")))
    return m.select("period", "rowid", X.snippet(F.col("body"), F.lit("老朽化")).alias("snippet"), X.marked_snippet(F.col("body"), F.lit("老朽化"), opening="[", closing="]").alias("marked"), F.substring("body", 1, 160).alias("head"))


def text_highlight(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.highlight(F.col("text"), ["データ", "minister", "予算"]).alias("html"), F.size(X.paragraphs(F.col("text"))).alias("n_paragraphs"), X.json_script(F.col("text")).alias("script"))


def text_keys(spark, sf_dir):
    p = table(spark, sf_dir, "politician")
    return p.select("id", X.unit_key(F.col("name"), F.col("name_kana"), F.col("district")).alias("unit"), X.safe_url(F.col("official_url")).alias("url"), X.last_segment(F.col("official_url")).alias("segment"))


def text_name_parts(spark, sf_dir):
    whole, lead = X.prefixes_and_parts(F.col("name"))
    p = table(spark, sf_dir, "politician").select("id", whole.alias("parts"), lead.alias("lead"))
    return p.select("id", F.array_join(F.array_sort("parts"), "|").alias("parts"), F.array_join("lead", "|").alias("lead"))


def text_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "party_map").select("kaiha", X.fingerprint(F.col("parties")).alias("fp"))


def text_formats(spark, sf_dir):
    p = table(spark, sf_dir, "politician").where("first_date IS NOT NULL")
    return p.select("id", R.weekday_text(F.col("first_date")).alias("day"), R.span_text(F.col("first_date"), F.col("last_date")).alias("span"), F.format_number("n_speeches", 0).alias("n"))


def id_ranges(spark, sf_dir):
    found = R.id_ranges(table(spark, sf_dir, "affiliation"), "id", ["politician_id"])
    return found.withColumn("back", F.size(R.parse_ranges(F.col("ids"))))


def period_ids(spark, sf_dir):
    m = meetings(spark, sf_dir)
    period = P.period_of(F.col("date"))
    return m.select("issue_id", period.alias("half"), P.period_of(F.col("date"), "year").alias("year"), P.period_of_issue_id(F.col("issue_id")).alias("from_issue"), P.period_of_speech_id(F.concat("issue_id", F.lit("_3"))).alias("from_speech"), P.period_index(period).alias("place"), P.period_year(period).alias("y"), P.overdue(F.col("date"), F.lit("2026-07-01").cast("date"), 365).alias("old"))


def period_months(spark, sf_dir):
    return stats(spark, sf_dir).select("period", F.explode(P.months_in_period(F.col("period"), F.col("first_date"), F.col("last_date"))).alias("month"))


def period_gaps(spark, sf_dir):
    place = P.period_index(F.col("period"))
    return stats(spark, sf_dir).where("period NOT IN ('2022H2', '2024H1')").select("period", (place - F.lag(place).over(Window.orderBy("period"))).alias("step")).where("step > 1")


def facts_classify(spark, sf_dir):
    is_speech, kind = FA.classify(F.col("speaker"), F.col("speaker_role"), F.col("speaker_yomi"))
    return table(spark, sf_dir, "speech").select(is_speech.alias("is_speech"), kind.alias("kind")).groupBy("is_speech", "kind").agg(F.count("*").alias("n"))


def facts_rowids(spark, sf_dir):
    return facts(spark, sf_dir).select("period", "rowid", "row_id", "speech_id")


def facts_stats(spark, sf_dir):
    return stats(spark, sf_dir)


def facts_kinds(spark, sf_dir):
    return FA.kind_shares(facts(spark, sf_dir))


def facts_catalog(spark, sf_dir):
    now = stats(spark, sf_dir).select(F.col("period").alias("id"), F.col("speeches").alias("n"), F.col("last_date").cast("string").alias("version"))
    old = now.where("id >= '2023H1'").select("id", (F.col("n") - 1).alias("n"), F.when(F.col("id") == "2024H1", "x").otherwise(F.col("version")).alias("version"))
    return FA.merge_catalog(old, now.where("id < '2025H1'"))


def report_missing(spark, sf_dir):
    return R.missing_shares(table(spark, sf_dir, "speech").drop("fetched_at"))


def report_top_values(spark, sf_dir):
    return R.top_values(table(spark, sf_dir, "speech"), "speaker_group", 20)


def report_odd_blanks(spark, sf_dir):
    return R.odd_blanks(table(spark, sf_dir, "affil_snapshot"), ["kaiha", "party"])


def report_volume(spark, sf_dir):
    return R.yearly_volume(table(spark, sf_dir, "speech"))


def report_next_ids(spark, sf_dir):
    p = table(spark, sf_dir, "politician").select("id")
    return R.next_ids(p.where("id % 7 <> 3 OR id > 20"), p.where("id <= 20"))


def stream_ingest(spark, sf_dir):
    """Speeches as raw files through the incremental ingest: what each period holds afterwards."""
    s = table(spark, sf_dir, "speech")
    base = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    raw = s.where("speech_id IS NOT NULL").select(*[(F.date_format(n, "yyyy-MM-dd") if n == "date" else F.col(n)).alias(c) for c, n in SPEECH_COLUMNS.items()], F.col("fetched_at"), F.col("row_id"))
    # One file in order of fetching, so that positions tell versions apart as they do at the source.
    latest = raw.withColumn("_r", F.struct("fetched_at", "row_id"))
    first = latest.groupBy("speechID").agg(F.min("_r").alias("_first"))
    old = latest.join(first, "speechID")
    old.where("_r = _first").drop("_r", "_first", "fetched_at", "row_id").write.mode("overwrite").json(f"{base}/first")
    newest = old.where("_r > _first").groupBy("speechID").agg(F.max_by(F.struct(*raw.columns), "_r").alias("x")).select("x.*")
    newest.drop("fetched_at", "row_id").write.mode("overwrite").json(f"{base}/second")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.Path(f"{base}/in"))
    for part in ("first", "second"):
        for k, status in enumerate(fs.listStatus(hadoop.Path(f"{base}/{part}"))):
            if status.getPath().getName().endswith(".json"):
                fs.rename(status.getPath(), hadoop.Path(f"{base}/in/{part}-{k:03d}.ndjson"))
        start_ingest(spark, f"{base}/in", f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/table").groupBy("period").agg(F.count("*").alias("speeches"), F.sum(F.length("body")).alias("letters"))


QUERIES = {f.__name__: f for f in (text_widths, text_runs, text_occurrences, text_snippets, text_highlight, text_keys, text_name_parts, text_fingerprints, text_formats, id_ranges, period_ids, period_months, period_gaps, facts_classify, facts_rowids, facts_stats, facts_kinds, facts_catalog, report_missing, report_top_values, report_odd_blanks, report_volume, report_next_ids, stream_ingest)}

_STATS = "stats AS (SELECT period, count(DISTINCT issue_id) AS meetings, count(*) AS speeches, count(*) FILTER (speaker_kind = '議員') AS indexed, min(date) AS first_date, max(date) AS last_date FROM facts GROUP BY period)"
_HALF = "strftime({0}, '%Y') || CASE WHEN month({0}) <= 6 THEN 'H1' ELSE 'H2' END"
_SPEECH = ["row_id", "speech_id", "issue_id", "speech_order", "date", "speaker", "speaker_yomi", "speaker_group", "speaker_position", "speaker_role", "body", "start_page", "speech_url", "is_speech", "speaker_kind", "politician_id", "period"]

ORACLES = {
    "text_widths": f"SELECT id, {sql_wide('official_url')} AS wide, {sql_fold(sql_wide('wikidata_id'))} AS key, {sql_hiragana('name_kana')} AS hiragana, {sql_hiragana('''regexp_replace(name_kana, '[ \\t\\n\\r\\f\\x0b　]', '', 'g')''')} AS folded, coalesce(regexp_matches(wikidata_name, '[぀-ヿ一-鿿]'), false) AS japanese FROM politician",
    "text_runs": with_facts(" SELECT period, rowid, len(r) AS n, array_to_string(r, '|') AS runs FROM (SELECT period, rowid, regexp_extract_all(body, '[一-鿿々]{2,}|[ァ-ヴー]{2,}|[Ａ-Ｚａ-ｚ０-９]{2,}') AS r FROM members)"),
    "text_occurrences": with_facts(" SELECT period, rowid, CAST((length(body) - length(replace(body, 'データ', ''))) / 3 AS BIGINT) AS n FROM members WHERE contains(body, 'データ')"),
    "text_snippets": with_facts(""" SELECT period, rowid, substr(body, greatest(1, instr(body, '老朽化') - 40), 160) AS snippet,
        (CASE WHEN s > 1 THEN '…' ELSE '' END) || substr(body, s, p - s) || '[老朽化]' || substr(body, p + 3, s + 26 - p - 3) || (CASE WHEN s + 26 <= length(body) THEN '…' ELSE '' END) AS marked, substr(body, 1, 160) AS head
        FROM (SELECT *, instr(body, '老朽化') AS p, greatest(1, instr(body, '老朽化') - 12) AS s FROM members WHERE contains(body, '老朽化'))"""),
    "text_highlight": """SELECT doc_id, regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'), '(minister|データ|予算)', '<mark>\\1</mark>', 'gi') AS html,
        len(list_filter(list_transform(string_split_regex(text, '\\n+'), lambda x: regexp_replace(x, '^[\\s　]+|[\\s　]+$', '', 'g')), lambda x: x <> '')) AS n_paragraphs, replace(text, '<', '\\u003c') AS script FROM documents""",
    "text_keys": "SELECT id, coalesce(name, '') || chr(9) || coalesce(name_kana, '') || chr(9) || coalesce(district, '') AS unit, CASE WHEN regexp_matches(lower(trim(official_url)), '^https?://') AND NOT regexp_matches(trim(official_url), '\\s') THEN trim(official_url) END AS url, string_split(official_url, '/')[-1] AS segment FROM politician",
    "text_name_parts": """WITH parts AS (SELECT DISTINCT p.id, substr(p.name, CAST(i AS INT), CAST(k AS INT)) AS part FROM politician p, LATERAL (SELECT unnest(range(2, length(p.name) + 1)) AS k), LATERAL (SELECT unnest(range(1, length(p.name) - k + 2)) AS i))
        SELECT p.id, coalesce((SELECT string_agg(part, '|' ORDER BY part) FROM parts q WHERE q.id = p.id), '') AS parts, array_to_string(list_filter([CASE WHEN length(name) >= 2 THEN substr(name, 1, 2) END, CASE WHEN length(name) >= 3 THEN substr(name, 1, 3) END, CASE WHEN length(name) >= 4 THEN substr(name, 1, 4) END], lambda x: x IS NOT NULL), '|') AS lead FROM politician p""",
    "text_fingerprints": "SELECT kaiha, substr(sha256(coalesce(array_to_string(parties, chr(10)), '')), 1, 16) AS fp FROM party_map",
    "text_formats": """SELECT id, strftime(first_date, '%Y-%m-%d') || '（' || ['月','火','水','木','金','土','日'][isodow(first_date)] || '）' AS day,
        strftime(first_date, '%Y-%m-%d') || '〜' || CASE WHEN year(first_date) = year(last_date) THEN strftime(last_date, '%m-%d') ELSE strftime(last_date, '%Y-%m-%d') END AS span, format('{:,}', n_speeches) AS n FROM politician WHERE first_date IS NOT NULL""",
    "id_ranges": """WITH x AS (SELECT DISTINCT politician_id, CAST(id AS BIGINT) AS id FROM affiliation), g AS (SELECT politician_id, id, id - row_number() OVER (PARTITION BY politician_id ORDER BY id) AS k FROM x),
        r AS (SELECT politician_id, k, min(id) AS a, max(id) AS b FROM g GROUP BY ALL)
        SELECT politician_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS ids, CAST(sum(b - a + 1) AS INT) AS back FROM r GROUP BY politician_id""",
    "period_ids": f"SELECT issue_id, {_HALF.format('date')} AS half, strftime(date, '%Y') AS year, {_HALF.format('d')} AS from_issue, {_HALF.format('d')} AS from_speech, CAST(year(date) * 2 + CASE WHEN month(date) <= 6 THEN 0 ELSE 1 END AS INT) AS place, CAST(year(date) AS INT) AS y, date_diff('day', date, DATE '2026-07-01') > 365 AS old FROM (SELECT *, CAST(strptime(regexp_extract(issue_id, '(\\d{{8}})$', 1), '%Y%m%d') AS DATE) AS d FROM meeting)",
    "period_months": with_facts(" SELECT DISTINCT period, strftime(m, '%Y-%m') AS month FROM (SELECT period, unnest(generate_series(date_trunc('month', first_date), date_trunc('month', last_date), INTERVAL 1 MONTH)) AS m FROM stats)", _STATS),
    "period_gaps": with_facts(" SELECT period, step FROM (SELECT period, CAST(k - lag(k) OVER (ORDER BY period) AS INT) AS step FROM (SELECT period, CAST(substr(period, 1, 4) AS INT) * 2 + CAST(substr(period, 6, 1) AS INT) - 1 AS k FROM stats WHERE period NOT IN ('2022H2', '2024H1'))) WHERE step > 1", _STATS),
    "facts_classify": "SELECT CAST(CASE WHEN speaker = '会議録情報' THEN 0 ELSE 1 END AS INT) AS is_speech, CASE WHEN speaker = '会議録情報' THEN '非発言' WHEN speaker_role IN ('参考人', '公述人', '証人') THEN speaker_role WHEN length(speaker_yomi) > 0 THEN '議員' ELSE '政府参考人等' END AS kind, count(*) AS n FROM speech GROUP BY ALL",
    "facts_rowids": f"WITH {FACTS} SELECT period, rowid, row_id, speech_id FROM facts",
    "facts_stats": with_facts(" SELECT * FROM stats", _STATS),
    "facts_kinds": f"WITH {FACTS} SELECT speaker_kind, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 1) AS percent FROM facts GROUP BY speaker_kind",
    "facts_catalog": with_facts(""", now AS (SELECT period AS id, speeches AS n, CAST(last_date AS VARCHAR) AS version FROM stats),
        old AS (SELECT id, n - 1 AS n, CASE WHEN id = '2024H1' THEN 'x' ELSE version END AS version FROM now WHERE id >= '2023H1'), fresh AS (SELECT * FROM now WHERE id < '2025H1')
        SELECT coalesce(f.id, o.id) AS id, CASE WHEN f.id IS NOT NULL THEN f.n ELSE o.n END AS n, CASE WHEN f.id IS NOT NULL THEN f.version ELSE o.version END AS version, coalesce(f.id IS NOT NULL AND o.version IS NOT NULL AND o.version <> f.version, false) AS changed FROM old o FULL JOIN fresh f ON o.id = f.id""", _STATS),
    "report_missing": " UNION ALL ".join(f"SELECT '{c}' AS field, round(avg(CASE WHEN {c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '' THEN 100.0 ELSE 0.0 END), 1) AS missing_percent FROM speech" for c in _SPEECH),
    "report_top_values": "SELECT speaker_group AS value, count(*) AS n FROM speech GROUP BY 1 ORDER BY n DESC, value NULLS FIRST LIMIT 20",
    "report_odd_blanks": " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (regexp_matches({c}, '^[\\s　]|[\\s　]$|[ 　]{{2,}}|[\\t\\x{{00a0}}\\x{{2002}}\\x{{2003}}\\x{{202f}}\\x{{205f}}]')) AS n FROM affil_snapshot" for c in ("kaiha", "party")),
    "report_volume": "SELECT CAST(year(date) AS INT) AS year, count(*) AS records, CAST(ceil(count(*) / 100) AS BIGINT) AS requests, round(ceil(count(*) / 100) * 3.0 / 3600, 2) AS hours FROM speech GROUP BY 1",
    "report_next_ids": "SELECT max(id) + 1 AS next_id, list_sort(list(id) FILTER (id <= 20 AND id % 7 = 3)) AS retired FROM politician",
    "stream_ingest": f"WITH {FACTS} SELECT period, count(*) AS speeches, CAST(sum(length(body)) AS BIGINT) AS letters FROM facts GROUP BY period",
}
