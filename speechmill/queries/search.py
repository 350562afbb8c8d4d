"""Queries of the search paths, paging, postings and checks."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.periods import periods_in_years
from ..operators import quality as Q
from ..operators.postings import bigram_postings, document_frequency, topic_postings, topic_table
from ..operators.series import speech_totals, trend_mode
from ..plans import search as S
from ..plans.query_text import Plan, split_terms, unsearchable_terms, word_plan
from ..session import table
from ..sources.build import period_entries, totals
from .base import FACTS, HITS, TOPICS, bigram_df, facts, index, meetings, members, sql_fold, stats, with_facts

FTS = Plan("fts", terms=tuple(split_terms("老朽化 データ")))
SDGS = Plan("fts", terms=tuple(split_terms("sdgs")))
WORD = Plan("word", driver="年金", filters=("データ",))
TOPIC = Plan("topic", topic=3)


def _asked(spark, sf_dir, plan, options=S.Options()):
    return facts(spark, sf_dir), meetings(spark, sf_dir), options, plan, TOPICS, index(spark, sf_dir)


def _hits(spark, sf_dir, plan, options=S.Options()):
    return S.hits(*_asked(spark, sf_dir, plan, options))


def _page(plan, options, spark, sf_dir):
    rows = S.result_rows(S.page_hits(*_asked(spark, sf_dir, plan, options)), meetings(spark, sf_dir), plan, TOPICS)
    return rows.withColumn("politician_id", F.coalesce("politician_id", F.lit(0)))


def _count(plan, options, spark, sf_dir):
    return S.count_hits(*_asked(spark, sf_dir, plan, options))


def _months(plan, options, spark, sf_dir):
    return S.month_hits(*_asked(spark, sf_dir, plan, options))


NONE = S.Options()
FILTERED = S.Options(politician=1, periods=tuple(periods_in_years(["2021H1", "2021H2", "2022H1", "2023H1", "2023H2", "2024H1", "2024H2"], 2024, 2021)))
PAGE_2 = S.Options(before={"2026H1": 1, "2025H2": 120, "2025H1": 0})


def search_in_meeting(spark, sf_dir):
    """The meeting is the largest one by name, so that the filter always has hits."""
    name = meetings(spark, sf_dir).groupBy("name").count().orderBy(F.desc("count"), "name").first().name
    return S.months(_hits(spark, sf_dir, Plan("fts", terms=("データ",)), S.Options(meeting=name)))


def search_word_scanned(spark, sf_dir):
    """The same hits as search_word_months, from the texts alone."""
    return S.months(S.hits(facts(spark, sf_dir), meetings(spark, sf_dir), NONE, WORD, TOPICS))


def search_long_count(spark, sf_dir):
    """Terms longer than the keys: the lists leave a doubt that the texts settle."""
    return S.count_hits(*_asked(spark, sf_dir, Plan("fts", terms=("の老朽化", "データ"))))


def search_bundled(spark, sf_dir):
    """A query as typed, through topics, frequencies and plan to its hits by month."""
    found = S.search_bundle(" 年金　データ", facts(spark, sf_dir), meetings(spark, sf_dir), bigram_df(spark, sf_dir), S.Options(), TOPICS, index(spark, sf_dir))
    return found["months"].withColumn("shown", F.lit(found["query"]))


def search_planned(spark, sf_dir):
    """A query typed in half width and with two short terms: the rarer one leads."""
    counts = {r.term: r.n for r in bigram_df(spark, sf_dir).where(F.col("term").isin("ＡＩ", "年金")).groupBy("term").agg(F.sum("n_speeches").alias("n")).collect()}
    plan = word_plan(split_terms("ai 年金"), counts)
    return S.count_by_period(_hits(spark, sf_dir, plan)).withColumn("driver", F.lit(plan.driver))


def search_impossible(spark, sf_dir):
    """Terms of two characters taken from the texts across two scripts, as a user would type them: none is found on any path."""
    typed = [r.t for r in members(spark, sf_dir).select(F.regexp_extract("body", "([一-鿿][ぁ-ん])", 1).alias("t")).where("t <> ''").groupBy("t").count().orderBy(F.desc("count"), "t").limit(5).collect()]
    parts = [S.count_hits(*_asked(spark, sf_dir, word_plan([t], {}))).withColumn("term", F.lit(t)) for t in typed if unsearchable_terms([t])]
    return reduce(lambda a, b: a.unionByName(b), parts)


def search_offset(spark, sf_dir):
    return _hits(spark, sf_dir, TOPIC).orderBy(F.desc("period"), F.desc("rowid")).offset(80).limit(20).select("period", "rowid")


def search_by_period(spark, sf_dir):
    return S.count_by_period(_hits(spark, sf_dir, FTS))


def search_walk(spark, sf_dir):
    """All pages of a search: every hit once, in order, with its page."""
    return S.walk(_hits(spark, sf_dir, FTS), 25)


def search_first_pages(spark, sf_dir):
    """Three pages, one after another, by the cursors of each."""
    periods = sorted((r.period for r in stats(spark, sf_dir).select("period").collect()), reverse=True)
    before, rows = {}, []
    for _ in range(3):
        shown = S.search_page(facts(spark, sf_dir), meetings(spark, sf_dir), periods, S.Options(limit=25, before=before), FTS, TOPICS, index(spark, sf_dir))
        rows, before = rows + shown.rows, shown.before
    return spark.createDataFrame([(k, p, r) for k, (p, r) in enumerate(rows)], "place int, period string, rowid long")


def timeline_pages(spark, sf_dir):
    """Two pages of a person's speeches in the periods between their first and last."""
    person = facts(spark, sf_dir).where("politician_id = 1").agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    periods = S.active_periods(person.a, person.b, [r.period for r in stats(spark, sf_dir).select("period").collect()])
    one = S.timeline_page(facts(spark, sf_dir), 1, periods, S.Options(limit=20))
    two = S.timeline_page(facts(spark, sf_dir), 1, periods, S.Options(limit=20, before=one.before))
    return spark.createDataFrame([(k, p, r) for k, (p, r) in enumerate(one.rows + two.rows)], "place int, period string, rowid long")


def politician_timeline(spark, sf_dir):
    return S.timeline(facts(spark, sf_dir), 1, S.Options(limit=50))


def _one(spark, sf_dir):
    return facts(spark, sf_dir).where("period = '2024H1'").orderBy(F.desc("rowid")).select("speech_id", "issue_id", "speech_order").first()


def speech_detail(spark, sf_dir):
    return S.speech_detail(facts(spark, sf_dir), _one(spark, sf_dir).speech_id).select("period", "rowid", "speech_id", "body")


def speech_context(spark, sf_dir):
    at = _one(spark, sf_dir)
    return S.context(facts(spark, sf_dir), at.issue_id, at.speech_order)


def context_frames(spark, sf_dir):
    """For every speech the number of speeches up to three before and after it in its meeting, as a range frame."""
    w = Window.partitionBy("issue_id").orderBy("speech_order").rangeBetween(-3, 3)
    return facts(spark, sf_dir).select("period", "rowid", (F.count("*").over(w) - 1).alias("near"))


def meeting_names(spark, sf_dir):
    return S.meeting_names(meetings(spark, sf_dir))


def search_trend_mode(spark, sf_dir):
    totals = speech_totals(members(spark, sf_dir)).where("kaiha = '*'").select("month", "total")
    return trend_mode(S.months(_hits(spark, sf_dir, FTS)), totals)


def bigram_frequencies(spark, sf_dir):
    return bigram_df(spark, sf_dir).groupBy("term").agg(F.sum("n_speeches").alias("n_speeches"))


def bigram_letters(spark, sf_dir):
    return bigram_postings(members(spark, sf_dir), ["period", "rowid"])


def topic_hits(spark, sf_dir):
    return topic_postings(members(spark, sf_dir), TOPICS, ["period", "rowid"])


def topic_frequencies(spark, sf_dir):
    return document_frequency(topic_postings(members(spark, sf_dir), TOPICS, ["period", "rowid"]), ["period", "topic_id"])


def missing_topics(spark, sf_dir):
    listed = topic_table(spark, TOPICS)
    return listed.join(topic_hits(spark, sf_dir).select(F.col("topic_id").alias("id")).distinct(), "id", "left_anti").select("id", "term")


def json_variants(spark, sf_dir):
    listed = topic_table(spark, TOPICS).select("id", F.to_json("variants").alias("j"))
    return listed.select("id", F.explode(F.from_json("j", "array<string>")).alias("variant"))


def topic_categories(spark, sf_dir):
    """Categories by their number of topics, as they head the list."""
    return topic_table(spark, TOPICS).groupBy("category").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("term")), ",").alias("terms"))


def topic_routes(spark, sf_dir):
    """Terms of the corpus with where a link to them leads: a topic, a word page, or the search."""
    known = topic_table(spark, TOPICS).select(F.explode(F.array_union(F.array("term"), "variants")).alias("term"), F.col("id").alias("topic_id")).dropDuplicates(["term"])
    words = bigram_frequencies(spark, sf_dir).where("n_speeches >= 30")
    route = F.when(F.col("topic_id").isNotNull(), "topic").when(F.col("n_speeches") >= 60, "word").otherwise("search")
    return words.join(F.broadcast(known), "term", "left").select("term", F.coalesce("topic_id", F.lit(0)).alias("topic_id"), route.alias("route"))


def check_arrival(spark, sf_dir):
    return Q.arrival_inversions(table(spark, sf_dir, "speech"))


def check_bounds(spark, sf_dir):
    return Q.month_bounds(facts(spark, sf_dir))


def _counted(parts):
    """(problem, n) of several checks."""
    return reduce(lambda a, b: a.unionByName(b), [found.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n") for name, found in parts])


def _listed_pairs(lists):
    return lists.select("term", "period", F.explode("rowids").alias("rowid"))


def check_all(spark, sf_dir):
    """(problem, n): every check over the tables as built; all are to be 0. Frequencies and lists are stored apart, so they can differ."""
    f, m, at = facts(spark, sf_dir), members(spark, sf_dir), index(spark, sf_dir)
    pairs = _listed_pairs(at.pairs)
    manifest = period_entries(f, at, TOPICS).withColumn("size_mb", F.lit(1.0))
    held = at.topics.groupBy("topic_id").agg(F.count("*").alias("n_speeches")).withColumnRenamed("topic_id", "id")
    return _counted([
        ("order", Q.inversions(f)), ("bounds", Q.bound_mismatches(f)), ("coverage", Q.coverage_problems(stats(spark, sf_dir))), ("catalog", Q.catalog_problems(manifest)),
        ("frequencies", Q.frequency_mismatches(bigram_frequencies(spark, sf_dir), pairs, "term")), ("false hits", Q.false_hits(pairs, m)), ("false topic hits", Q.false_topic_hits(at.topics, m, TOPICS)),
        ("topics", Q.frequency_mismatches(held.withColumn("id", F.col("id")), topic_postings(m, TOPICS, ["period", "rowid"]).withColumnRenamed("topic_id", "id"), "id")),
    ])


def check_faults(spark, sf_dir):
    """The same checks on the corpus spoilt by rule: dates set back, frequencies raised, postings and hits that no text holds, periods misdated."""
    f, m, at = facts(spark, sf_dir), members(spark, sf_dir), index(spark, sf_dir)
    spoilt = f.select("period", "rowid", F.when(F.col("rowid") % 97 == 0, F.date_sub("date", 4000)).otherwise(F.col("date")).alias("date"))
    raised = bigram_frequencies(spark, sf_dir).withColumn("n_speeches", F.col("n_speeches") + F.when(F.startswith("term", F.lit("デ")), 1).otherwise(0))
    foreign = m.select(F.lit("〆〆").alias("term"), "period", "rowid").where("rowid % 50 = 0")
    hits = m.select("period", F.lit(7).alias("topic_id"), "rowid").where("rowid % 60 = 0")
    moved = stats(spark, sf_dir).withColumn("last_date", F.date_add("last_date", 200))
    manifest = period_entries(f, at, TOPICS).select("id", F.when(F.endswith("id", F.lit("H1")), "").otherwise(F.col("version")).alias("version"), F.when(F.startswith("id", F.lit("2022")), 900.0).otherwise(1.0).alias("size_mb")).where("id <> '2023H1'")
    pairs = _listed_pairs(at.pairs)
    return _counted([("order", Q.inversions(spoilt)), ("coverage", Q.coverage_problems(moved)), ("catalog", Q.catalog_problems(manifest)), ("frequencies", Q.frequency_mismatches(raised, pairs, "term")), ("false hits", Q.false_hits(foreign, m)), ("false topic hits", Q.false_topic_hits(hits, m, TOPICS))])


def topic_faults(spark, sf_dir):
    """A stored list of topics against the one in use: the topics the corpus has no hit of are taken as missing from it."""
    listed = topic_table(spark, TOPICS)
    held = listed.join(index(spark, sf_dir).topics.select(F.col("topic_id").alias("id")).distinct(), "id", "left_semi").withColumn("term", F.when(F.col("id") == 3, "恩給").otherwise(F.col("term")))
    return Q.topic_differences(held, listed)


def manifest_entries(spark, sf_dir):
    return period_entries(facts(spark, sf_dir), index(spark, sf_dir), TOPICS).drop("version", "topics_fp")


def manifest_totals(spark, sf_dir):
    return totals(period_entries(facts(spark, sf_dir), index(spark, sf_dir), TOPICS))


def topics_indexed(spark, sf_dir):
    listed = topic_table(spark, TOPICS).select("id", F.substring(F.sha2(F.concat_ws("|", F.col("id").cast("string"), "term", F.array_join("variants", ",")), 256), 1, 16).alias("fp"))
    prints = F.array(*[F.struct(F.lit(r.id).alias("id"), F.lit(r.fp).alias("fp")) for r in listed.collect()])
    parts = stats(spark, sf_dir).select("period", F.explode(prints).alias("_t")).select("period", "_t.id", "_t.fp").where("NOT (period = '2023H1' AND id = 5)").withColumn("fp", F.when((F.col("period") == "2022H2") & (F.col("id") == 6), "old").otherwise(F.col("fp")))
    return Q.indexed_topics(listed, parts.groupBy("period", "fp").agg(F.collect_list("id").alias("ids")))


QUERIES = {
    **{f"search_{n}_{kind}": partial(make, plan, NONE) for n, plan in (("fts", FTS), ("fold", SDGS), ("word", WORD), ("topic", TOPIC)) for kind, make in (("page", _page), ("count", _count), ("months", _months))},
    **{f"search_filtered_{n}": partial(_count, plan, FILTERED) for n, plan in (("fts", FTS), ("word", WORD), ("topic", TOPIC))},
    "search_page_2": partial(_page, TOPIC, PAGE_2),
    **{f.__name__: f for f in (search_in_meeting, search_word_scanned, search_long_count, search_bundled, search_first_pages, timeline_pages, search_planned, search_impossible, search_offset, search_by_period, search_walk, politician_timeline, speech_detail, speech_context, context_frames, meeting_names, search_trend_mode, bigram_frequencies, bigram_letters, topic_hits, topic_frequencies, missing_topics, json_variants, topic_categories, topic_routes, check_arrival, check_bounds, check_all, check_faults, topic_faults, manifest_entries, manifest_totals, topics_indexed)},
}

_LOOSE = f"contains({sql_fold('body')}, '{{0}}') AND list_contains(list_transform(regexp_extract_all({sql_fold('body')}, '[一-鿿々]{{{{2,}}}}|[ァ-ヴー]{{{{2,}}}}|[Ａ-Ｚａ-ｚ０-９]{{{{2,}}}}'), lambda r: contains(r, '{{0}}')), true)".replace("{{0}}", "{0}").replace("{{{{", "{{").replace("}}}}", "}}")
_WHERE = {"fts": "contains(lower(body), '老朽化') AND contains(lower(body), 'データ')", "fold": "contains(lower(body), 'ｓｄｇｓ')", "word": _LOOSE.format("年金") + " AND instr(body, 'データ') > 0", "topic": "(contains(body, '年金') OR contains(body, '年金制度'))"}
_FIRST = {"fts": ("老朽化", True), "fold": ("ｓｄｇｓ", True), "word": ("年金", False), "topic": ("年金", False)}


def _sql_snippet(name: str) -> str:
    """The snippet of a result row, for DuckDB: a plain window, or one with the hit marked."""
    term, marked = _FIRST[name]
    if not marked:
        return f"substr(m.body, greatest(1, instr(m.body, '{term}') - 40), 160)"
    at, n = f"instr(lower(m.body), '{term}')", len(term)
    start = f"greatest(1, {at} - 12)"
    return f"(CASE WHEN {start} > 1 THEN '…' ELSE '' END || substr(m.body, {start}, {at} - {start}) || chr(1) || substr(m.body, {at}, {n}) || chr(2) || substr(m.body, {at} + {n}, greatest(0, {start} + 26 - {at} - {n})) || CASE WHEN {start} + 26 <= length(m.body) THEN '…' ELSE '' END)"


_ROWS = " SELECT m.period, m.rowid, m.speech_id, m.issue_id, m.date, m.speaker, m.speaker_group, coalesce(m.politician_id, 0) AS politician_id, g.name AS meeting, g.house, g.session, {1} AS snippet FROM (SELECT * FROM members WHERE {0} ORDER BY period DESC, rowid DESC LIMIT 20) m JOIN meeting g ON g.issue_id = m.issue_id"
_BY_MONTH = " SELECT strftime(date, '%Y-%m') AS month, count(*) AS n FROM members WHERE {0} GROUP BY 1"
_CUT = "politician_id = 1 AND period IN ('2021H1', '2021H2', '2022H1', '2023H1', '2023H2', '2024H1', '2024H2')"
_GRAMS = f"grams AS (SELECT DISTINCT period, rowid, substr({sql_fold('run')}, CAST(i AS INT), 2) AS term FROM (SELECT period, rowid, unnest(regexp_extract_all(body, '[一-鿿々]{{2,}}|[ァ-ヴー]{{2,}}|[Ａ-Ｚａ-ｚ０-９]{{2,}}')) AS run FROM members), LATERAL (SELECT unnest(range(1, length(run))) AS i))"
_ONE = "one AS (SELECT * FROM facts WHERE period = '2024H1' ORDER BY rowid DESC LIMIT 1)"
_TOPICS = "topics AS (SELECT * FROM (VALUES " + ", ".join(f"({t['id']}, '{t['term']}', '{t['category']}')" for t in TOPICS) + ") v(id, term, category))"
_DRIVER = "SELECT CASE WHEN (SELECT count(*) FROM members WHERE " + _LOOSE.format("ＡＩ") + ") <= (SELECT count(*) FROM members WHERE " + _LOOSE.format("年金") + ") THEN 'ＡＩ' ELSE '年金' END AS driver"

ORACLES = {
    **{f"search_{n}_page": with_facts(_ROWS.format(w, _sql_snippet(n))) for n, w in _WHERE.items()},
    **{f"search_{n}_count": with_facts(f" SELECT count(*) AS n FROM members WHERE {w}") for n, w in _WHERE.items()},
    **{f"search_{n}_months": with_facts(_BY_MONTH.format(w)) for n, w in _WHERE.items()},
    **{f"search_filtered_{n}": with_facts(f" SELECT count(*) AS n FROM members WHERE {_WHERE[n]} AND {_CUT}") for n in ("fts", "word", "topic")},
    "search_page_2": with_facts(_ROWS.format(_WHERE["topic"] + " AND NOT (period = '2026H1' AND rowid >= 1) AND NOT (period = '2025H2' AND rowid >= 120) AND period <> '2025H1'", _sql_snippet("topic"))),
    "search_in_meeting": with_facts(" SELECT strftime(date, '%Y-%m') AS month, count(*) AS n FROM members WHERE contains(body, 'データ') AND issue_id IN (SELECT issue_id FROM meeting WHERE name = (SELECT name FROM meeting GROUP BY name ORDER BY count(*) DESC, name LIMIT 1)) GROUP BY 1"),
    "search_word_scanned": with_facts(_BY_MONTH.format(_WHERE["word"])),
    "search_long_count": with_facts(" SELECT count(*) AS n FROM members WHERE contains(body, 'の老朽化') AND contains(body, 'データ')"),
    "search_bundled": with_facts(" SELECT strftime(date, '%Y-%m') AS month, count(*) AS n, ' 年金　データ' AS shown FROM members WHERE " + _WHERE["word"] + " GROUP BY 1"),
    "search_first_pages": with_facts(f" SELECT CAST(row_number() OVER (ORDER BY period DESC, rowid DESC) - 1 AS INT) AS place, period, rowid FROM members WHERE {_WHERE['fts']} QUALIFY place < 75"),
    "timeline_pages": with_facts(" SELECT CAST(row_number() OVER (ORDER BY period DESC, rowid DESC) - 1 AS INT) AS place, period, rowid FROM facts WHERE politician_id = 1 QUALIFY place < 40"),
    "search_planned": with_facts(f" SELECT period, count(*) AS n, driver FROM members, ({_DRIVER}) d WHERE CASE WHEN driver = 'ＡＩ' THEN {_LOOSE.format('ＡＩ')} AND instr(body, '年金') > 0 ELSE {_LOOSE.format('年金')} AND instr(body, 'ＡＩ') > 0 END GROUP BY ALL"),
    "search_impossible": with_facts(f" SELECT t AS term, (SELECT count(*) FROM grams WHERE grams.term = x.t) AS n FROM (SELECT regexp_extract(body, '([一-鿿][ぁ-ん])', 1) AS t, count(*) AS k FROM members WHERE t <> '' GROUP BY 1 ORDER BY k DESC, t LIMIT 5) x", _GRAMS),
    "search_offset": with_facts(f" SELECT period, rowid FROM members WHERE {_WHERE['topic']} ORDER BY period DESC, rowid DESC LIMIT 20 OFFSET 80"),
    "search_by_period": with_facts(f" SELECT period, count(*) AS n FROM members WHERE {_WHERE['fts']} GROUP BY period"),
    "search_walk": with_facts(f" SELECT CAST(row_number() OVER (ORDER BY period DESC, rowid DESC) - 1 AS INT) AS place, CAST(floor((row_number() OVER (ORDER BY period DESC, rowid DESC) - 1) / 25) AS INT) AS page, period, rowid FROM members WHERE {_WHERE['fts']}"),
    "politician_timeline": with_facts(" SELECT period, rowid, speech_id, date, substr(body, 1, 160) AS head FROM facts WHERE politician_id = 1 ORDER BY period DESC, rowid DESC LIMIT 50"),
    "speech_detail": with_facts(" SELECT period, rowid, speech_id, body FROM one", _ONE),
    "speech_context": with_facts(" SELECT f.speech_id, f.speech_order, f.speaker, substr(f.body, 1, 140) AS head, CASE WHEN f.speech_order < o.speech_order THEN 'before' WHEN f.speech_order > o.speech_order THEN 'after' ELSE 'self' END AS side FROM facts f, one o WHERE f.issue_id = o.issue_id AND f.speech_order BETWEEN greatest(0, o.speech_order - 3) AND o.speech_order + 3", _ONE),
    "context_frames": f"WITH {FACTS} SELECT period, rowid, count(*) OVER (PARTITION BY issue_id ORDER BY speech_order RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) - 1 AS near FROM facts",
    "meeting_names": "SELECT DISTINCT name FROM meeting",
    "search_trend_mode": with_facts(f", h AS (SELECT strftime(date, '%Y-%m') AS month, count(*) AS n FROM members WHERE {_WHERE['fts']} GROUP BY 1), t AS (SELECT strftime(date, '%Y-%m') AS month, count(*) AS total FROM members GROUP BY 1) SELECT h.month, n, total, 'rate' AS mode, n / total * 1000 AS rate FROM h LEFT JOIN t ON t.month = h.month"),
    "bigram_frequencies": with_facts(" SELECT term, count(*) AS n_speeches FROM grams GROUP BY term", _GRAMS),
    "bigram_letters": with_facts(" SELECT period, rowid, term FROM grams", _GRAMS),
    "topic_hits": with_facts(" SELECT topic_id, period, rowid, n FROM hits", HITS),
    "topic_frequencies": with_facts(" SELECT period, topic_id, count(*) AS n_speeches FROM hits GROUP BY ALL", HITS),
    "missing_topics": with_facts(" SELECT id, term FROM topics WHERE id NOT IN (SELECT topic_id FROM hits)", HITS, _TOPICS),
    "json_variants": "SELECT * FROM (VALUES " + ", ".join(f"({t['id']}, '{v}')" for t in TOPICS for v in t["variants"]) + ") x(id, variant)",
    "topic_categories": f"WITH {_TOPICS} SELECT category, count(*) AS n, string_agg(term, ',' ORDER BY term) AS terms FROM topics GROUP BY category",
    "topic_routes": with_facts(", f AS (SELECT form, min(topic_id) AS topic_id FROM forms GROUP BY form), d AS (SELECT term, count(*) AS n FROM grams GROUP BY term HAVING count(*) >= 30) SELECT term, coalesce(topic_id, 0) AS topic_id, CASE WHEN topic_id IS NOT NULL THEN 'topic' WHEN n >= 60 THEN 'word' ELSE 'search' END AS route FROM d LEFT JOIN f ON f.form = d.term", HITS, _GRAMS),
    "check_arrival": "SELECT period, count(*) FILTER (b > date) AS n FROM (SELECT period, date, lag(date) OVER (PARTITION BY period ORDER BY row_id) AS b FROM speech) GROUP BY period",
    "check_bounds": f"WITH {FACTS} SELECT period, strftime(date, '%Y-%m') AS month, min(rowid) AS first FROM facts GROUP BY ALL",
    "check_all": "SELECT unnest(['order', 'bounds', 'coverage', 'catalog', 'frequencies', 'false hits', 'false topic hits', 'topics']) AS problem, CAST(0 AS BIGINT) AS n",
    "check_faults": with_facts("""
        SELECT 'order' AS problem, count(DISTINCT period) AS n FROM (SELECT period, d, lag(d) OVER (PARTITION BY period ORDER BY rowid) AS b FROM (SELECT period, rowid, CASE WHEN rowid % 97 = 0 THEN date - 4000 ELSE date END AS d FROM facts)) WHERE b > d
        UNION ALL SELECT 'coverage', count(*) FROM (SELECT period, max(date) + 200 AS d FROM facts GROUP BY period) WHERE year(d) || CASE WHEN month(d) <= 6 THEN 'H1' ELSE 'H2' END <> period
        UNION ALL SELECT 'catalog', count(*) FILTER (period LIKE '%H1') + count(*) FILTER (period LIKE '2022%') + count(*) FILTER (period = '2023H2') FROM (SELECT DISTINCT period FROM facts WHERE period <> '2023H1')
        UNION ALL SELECT 'frequencies', count(DISTINCT term) FROM grams WHERE term LIKE 'デ%'
        UNION ALL SELECT 'false hits', count(*) FROM members WHERE rowid % 50 = 0 AND NOT contains(body, '〆〆')
        UNION ALL SELECT 'false topic hits', count(*) FROM members WHERE rowid % 60 = 0 AND NOT contains(body, '月面基地')""", _GRAMS),
    "topic_faults": with_facts(" SELECT id, 'missing' AS problem FROM topics WHERE id NOT IN (SELECT topic_id FROM hits) UNION ALL SELECT 3, 'other term' WHERE 3 IN (SELECT topic_id FROM hits)", HITS, _TOPICS),
    "manifest_entries": with_facts(", h AS (SELECT period, count(*) AS hits FROM hits GROUP BY period), w AS (SELECT period, count(DISTINCT term) AS words FROM grams GROUP BY period) SELECT f.period AS id, count(DISTINCT issue_id) AS meetings, count(*) AS speeches, count(*) FILTER (speaker_kind = '議員') AS indexed, coalesce(any_value(h.hits), 0) AS hits, coalesce(any_value(w.words), 0) AS words, strftime(min(date), '%Y-%m-%d') AS first_date, strftime(max(date), '%Y-%m-%d') AS last_date FROM facts f LEFT JOIN h ON h.period = f.period LEFT JOIN w ON w.period = f.period GROUP BY f.period", HITS, _GRAMS),
    "manifest_totals": with_facts(" SELECT count(DISTINCT period) AS periods, count(*) AS speeches, count(*) FILTER (speaker_kind = '議員') AS indexed, (SELECT count(*) FROM hits) AS hits, strftime(min(date), '%Y-%m-%d') AS first_date, strftime(max(date), '%Y-%m-%d') AS last_date FROM facts", HITS),
    "topics_indexed": "SELECT id, id NOT IN (5, 6) AS indexed FROM (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS id)",
}
