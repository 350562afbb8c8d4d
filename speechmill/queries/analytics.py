"""Queries of term mining, time series, activity and entity resolution. Thresholds suit the test corpus, not the reference's size."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.periods import month_of
from ..functions.text import CANDIDATE_PATTERN
from ..operators import activity as A
from ..operators import entity as E
from ..operators import mining as M
from ..operators import ranking as R
from ..operators import series as T
from ..operators.quality import month_bounds
from ..operators.facts import number_rows
from ..operators.postings import topic_table
from ..session import materialize, table
from ..sources import products as P
from ..sources.store import stored
from .base import FACTS, HITS, RUNS, TOPICS, bigram_df, facts, meetings, members, sql_fold, sql_hiragana, sql_name_key, stats, with_facts

DENIED = ["データ"]


# --- Mining


def _standing(spark, sf_dir):
    return stored(spark, "standing", sf_dir, lambda: M.standing_terms(members(spark, sf_dir)))


def _cells(spark, sf_dir):
    """Frequencies of the pool by month and session, written once."""
    return stored(spark, "cells", sf_dir, lambda: M.frequencies(members(spark, sf_dir), meetings(spark, sf_dir), M.pool(_standing(spark, sf_dir), 10, 5)))


def standing_terms(spark, sf_dir):
    return M.standing_terms(members(spark, sf_dir))


def pool_frequencies(spark, sf_dir):
    return M.frequencies(members(spark, sf_dir), meetings(spark, sf_dir), M.pool(M.standing_terms(members(spark, sf_dir)), 10, 5))


def mining_denominators(spark, sf_dir):
    return M.denominators(members(spark, sf_dir), meetings(spark, sf_dir))


def _totals(spark, sf_dir):
    return _cells(spark, sf_dir).groupBy("term").agg(F.sum("n").alias("n"))


def term_fragments(spark, sf_dir):
    """Of all two-character keys, those that mostly stand inside longer abbreviations."""
    totals = bigram_df(spark, sf_dir).groupBy("term").agg(F.sum("n_speeches").alias("n"))
    return M.fragments(_standing(spark, sf_dir), totals, 0.5)


def near_duplicate_terms(spark, sf_dir):
    return M.near_duplicates(_totals(spark, sf_dir), 0.75)


def kept_terms(spark, sf_dir):
    """Pool terms that are neither noise nor parts of names and offices."""
    return M.keep_words(_totals(spark, sf_dir).where(M.no_noise(F.col("term"))), facts(spark, sf_dir), DENIED)


def burst_terms(spark, sf_dir):
    volumes: dict[str, float] = {}
    for r in M.denominators(members(spark, sf_dir), meetings(spark, sf_dir)).collect():
        volumes[r.month[:4]] = volumes.get(r.month[:4], 0) + r.n_speeches
    by_year = _cells(spark, sf_dir).groupBy("term", F.substring("month", 1, 4).alias("year")).agg(F.sum("n").alias("n"))
    return M.bursts(M.yearly(by_year, volumes, 1000), sorted(volumes)).where("n >= 20").select("term", "n", F.round("burst", 6).alias("burst"), F.round("recency", 6).alias("recency"), "peak_year", "peak_n")


def frequent_words(spark, sf_dir):
    words = M.frequent_words(members(spark, sf_dir), meetings(spark, sf_dir), facts(spark, sf_dir), top=50, least=20, least_standing=10, least_standing_two=5, denied=DENIED)
    return words.withColumn("burst", F.round("burst", 6))


def word_years(spark, sf_dir):
    """Frequent words by the year of their peak, latest year first, as an index lists them."""
    words = M.frequent_words(members(spark, sf_dir), meetings(spark, sf_dir), facts(spark, sf_dir), top=50, least=20, least_standing=10, least_standing_two=5, denied=DENIED)
    return words.groupBy(F.substring("peak", 1, 4).alias("year")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("term")), ",").alias("terms")).orderBy(F.desc("year"))


def month_axis(spark, sf_dir):
    """Months that a chart needs: those with speeches and those with hits, inside the years asked for."""
    speeches = members(spark, sf_dir).select(month_of(F.col("date")).alias("month"))
    hits = _topic_cells(spark, sf_dir).where("topic_id = 3").select("month")
    return speeches.union(hits).distinct().where("month BETWEEN '2022-01' AND '2024-12'").orderBy("month")


def month_starts(spark, sf_dir):
    """The first row id of every month of a period's calendar; months without a speech have the largest number there is."""
    wanted = stats(spark, sf_dir).select("period", F.explode(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(F.substring("period", 1, 4), F.lit("-"), F.lpad((i + F.when(F.endswith("period", F.lit("2")), 6).otherwise(0)).cast("string"), 2, "0")))).alias("month"))
    return wanted.join(month_bounds(facts(spark, sf_dir)), ["period", "month"], "left").select("period", "month", F.coalesce("first", F.lit((1 << 53) - 1)).alias("first"))


def word_sessions(spark, sf_dir):
    words = _totals(spark, sf_dir).orderBy(F.desc("n"), "term").limit(30)
    return M.session_counts(_cells(spark, sf_dir), words)


def proposals(spark, sf_dir):
    found = M.proposals(members(spark, sf_dir), facts(spark, sf_dir), 20, 8, DENIED)
    return found.withColumns({"burst": F.round("burst", 6), "recency": F.round("recency", 6)})


def proposal_lists(spark, sf_dir):
    return M.proposal_lists(M.proposals(members(spark, sf_dir), facts(spark, sf_dir), 20, 8, DENIED), 40, 20, 30)


def _trend(spark, sf_dir):
    return M.trend_windows(members(spark, sf_dir), facts(spark, sf_dir), days=5, windows=8, top=20, least=3, denied=DENIED)


def trend_windows(spark, sf_dir):
    return _trend(spark, sf_dir).withColumn("lift", F.round("lift", 6))


def trend_new_terms(spark, sf_dir):
    known = [f for t in TOPICS for f in (t["term"], *t["variants"])]
    return M.new_terms(_trend(spark, sf_dir), known).select("term", "n", F.round("lift", 6).alias("lift"), F.array_join("windows", "/").alias("windows"))


def topic_candidates(spark, sf_dir):
    known = [f for t in TOPICS for f in (t["term"], *t["variants"])]
    frequent = burst_terms(spark, sf_dir).select("term", "burst")
    return M.topic_candidates(_trend(spark, sf_dir), frequent, known, 60).withColumn("score", F.round("score", 5))


# --- Series


def _topic_cells(spark, sf_dir):
    return T.topic_cells(members(spark, sf_dir), TOPICS)


def _speech_totals(spark, sf_dir):
    return T.speech_totals(members(spark, sf_dir))


def topic_cells(spark, sf_dir):
    return _topic_cells(spark, sf_dir)


def speech_totals(spark, sf_dir):
    return _speech_totals(spark, sf_dir)


def kept_groups(spark, sf_dir):
    return T.kept_groups(_speech_totals(spark, sf_dir), 150)


def topic_totals(spark, sf_dir):
    return T.topic_totals(_topic_cells(spark, sf_dir))


def meeting_totals(spark, sf_dir):
    return T.meeting_totals(members(spark, sf_dir), meetings(spark, sf_dir))


def topic_series(spark, sf_dir):
    """Dense monthly vectors by topic, as text."""
    axis = T.axis_months(members(spark, sf_dir))
    dense = T.dense(_topic_cells(spark, sf_dir).where("kaiha = '*'"), ["topic_id"], "month", "n_speeches", axis)
    return dense.select("topic_id", F.array_join(F.transform("series", lambda x: x.cast("string")), ",").alias("series"))


def topic_rates(spark, sf_dir):
    return T.low_support(T.rates(_topic_cells(spark, sf_dir), _speech_totals(spark, sf_dir)), 100)


def group_rates(spark, sf_dir):
    return T.bar_shares(T.group_rates(_topic_cells(spark, sf_dir), _speech_totals(spark, sf_dir), 150), ["topic_id"], "rate")


def topic_stacks(spark, sf_dir):
    return T.stacks(_topic_cells(spark, sf_dir))


def peak_months(spark, sf_dir):
    return T.peaks(T.rates(_topic_cells(spark, sf_dir), _speech_totals(spark, sf_dir)).where("kaiha = '*'")).select("topic_id", "month", "rate")


def sessions(spark, sf_dir):
    return T.sessions(members(spark, sf_dir), meetings(spark, sf_dir), 200).withColumns({"before": F.coalesce("before", F.lit(0)), "after": F.coalesce("after", F.lit(0))})


def session_lift(spark, sf_dir):
    words = _totals(spark, sf_dir).where("n >= 20")
    hits = M.session_counts(_cells(spark, sf_dir), words)
    total = members(spark, sf_dir).count()
    return T.session_lift(hits, T.sessions(members(spark, sf_dir), meetings(spark, sf_dir), 200), words, total, 5).withColumn("lift", F.round("lift", 6))


# --- Activity


def activity(spark, sf_dir):
    return A.activity(members(spark, sf_dir), meetings(spark, sf_dir))


def activity_top(spark, sf_dir):
    return A.fold_small(A.activity(members(spark, sf_dir), meetings(spark, sf_dir)), "politician_id", "name", "n", 7)


def activity_series(spark, sf_dir):
    """Sparse series and back to dense ones."""
    cells = members(spark, sf_dir).where("politician_id IS NOT NULL").groupBy("politician_id", month_of(F.col("date")).alias("month")).agg(F.count("*").alias("n"))
    axis = T.axis_months(members(spark, sf_dir))
    sparse = A.sparse_series(cells, ["politician_id"], "month", "n", axis)
    return sparse.select("politician_id", F.array_join(F.transform(T.densify(F.col("series"), len(axis)), lambda x: x.cast("string")), ",").alias("series"))


def activity_year(spark, sf_dir):
    return A.drop_empty(A.activity(members(spark, sf_dir), meetings(spark, sf_dir)), ["politician_id", "name"], "n", "2024")


def corpus_totals(spark, sf_dir):
    return A.corpus_totals(members(spark, sf_dir), stats(spark, sf_dir))


# --- Entities


def units(spark, sf_dir):
    return E.units(facts(spark, sf_dir), meetings(spark, sf_dir))


def speaker_stats(spark, sf_dir):
    return E.speaker_stats(facts(spark, sf_dir))


def _members_of_base(spark, sf_dir):
    """The people of the knowledge base: politicians with wikidata_id, their houses and every party they were in."""
    parties = table(spark, sf_dir, "affiliation").where("party IS NOT NULL").groupBy(F.col("politician_id").alias("id")).agg(F.array_sort(F.collect_set("party")).alias("parties"))
    p = table(spark, sf_dir, "politician").where("wikidata_id IS NOT NULL").join(parties, "id", "left")
    return p.select("id", "wikidata_id", "name", F.col("name_kana").alias("kana"), F.when(F.col("house").isNotNull(), F.array("house")).alias("houses"), "parties")


def _terms_of_office(spark, sf_dir):
    p = table(spark, sf_dir, "politician").where("wikidata_id IS NOT NULL").select("id", "wikidata_id")
    a = table(spark, sf_dir, "affiliation")
    return a.join(p, a.politician_id == p.id).select("wikidata_id", F.col("start_date").alias("start"), F.col("end_date").alias("end"))


def _matched(spark, sf_dir):
    return E.match_units(E.units(facts(spark, sf_dir), meetings(spark, sf_dir)), _members_of_base(spark, sf_dir), _terms_of_office(spark, sf_dir), table(spark, sf_dir, "party_map"))


def entity_match(spark, sf_dir):
    return _matched(spark, sf_dir)


def entity_report(spark, sf_dir):
    return E.match_report(_matched(spark, sf_dir)).fillna("", ["narrowed_by"])


def entity_people(spark, sf_dir):
    return E.people(_matched(spark, sf_dir))


def _no_ids(spark):
    return spark.createDataFrame([], "key string, id long")


def _assigned(spark, sf_dir):
    people = E.people(_matched(spark, sf_dir)).withColumn("local", E.local_key(F.col("name"), F.col("name_kana")))
    return E.assign_ids(people, _no_ids(spark))


def entity_ledger(spark, sf_dir):
    """Ids given to persons in the order of their speeches."""
    return _assigned(spark, sf_dir).select("person_key", "id")


def entity_keys(spark, sf_dir):
    """The keys known after that, each with its id."""
    return E.ledger(_assigned(spark, sf_dir), _no_ids(spark))


def entity_speeches(spark, sf_dir):
    """Every member's speech with the person its unit was resolved to."""
    matched = materialize(_matched(spark, sf_dir))
    people = E.people(matched).withColumn("local", E.local_key(F.col("name"), F.col("name_kana")))
    found = E.assign_speeches(members(spark, sf_dir), E.unit_map(matched, E.assign_ids(people, _no_ids(spark))))
    return found.select("row_id", "person_id")


def _party_rows(spark, sf_dir):
    base = _members_of_base(spark, sf_dir).select("wikidata_id", "parties")
    return _matched(spark, sf_dir).withColumnRenamed("speaker_group", "kaiha").join(base, "wikidata_id", "left").select("speaker", "speaker_yomi", "kaiha", "n_speeches", "wikidata_id", "parties")


def entity_parties(spark, sf_dir):
    return E.resolve_party(_party_rows(spark, sf_dir), table(spark, sf_dir, "party_map")).drop("parties")


def entity_unresolved(spark, sf_dir):
    return E.unresolved(E.resolve_party(_party_rows(spark, sf_dir), table(spark, sf_dir, "party_map")))


def override_recount(spark, sf_dir):
    """Each larger unit split at two days, recounted, with the parts that do not add up."""
    keys = ["speaker", "speaker_yomi", "speaker_group"]
    found = E.units(facts(spark, sf_dir), meetings(spark, sf_dir)).where("n_speeches >= 10")
    parts = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(a).cast("date").alias("from_date"), F.lit(b).cast("date").alias("until"), F.lit(p).alias("party")) for i, a, b, p in ((1, None, "2022-12-31", "甲"), (2, None, "2024-06-30", None), (3, "2024-08-01", None, "乙"))])
    overrides = found.select(*keys, F.explode(parts).alias("_p")).select(*keys, "_p.*")
    spans = E.override_spans(overrides, found, keys)
    return E.recount(spans, members(spark, sf_dir).select(*keys, "date"), keys).drop("start", "end")


def override_lost(spark, sf_dir):
    keys = ["speaker", "speaker_yomi", "speaker_group"]
    found = E.units(facts(spark, sf_dir), meetings(spark, sf_dir)).where("n_speeches >= 10")
    return E.reconcile(override_recount(spark, sf_dir), found, keys)


def affiliation_on_date(spark, sf_dir):
    return E.affiliation_on(members(spark, sf_dir).where("politician_id IS NOT NULL"), table(spark, sf_dir, "affiliation")).select("row_id", F.coalesce("affiliation_id", F.lit(0)).alias("affiliation_id"), "kaiha", "party")


def current_affiliation(spark, sf_dir):
    return E.current_affiliation(table(spark, sf_dir, "affiliation"))


def group_timeline(spark, sf_dir):
    return E.group_timeline(table(spark, sf_dir, "affiliation"), 1)


def _people_list(spark, sf_dir):
    now = E.current_affiliation(table(spark, sf_dir, "affiliation")).select(F.col("politician_id").alias("id"), "kaiha")
    return table(spark, sf_dir, "politician").join(now, "id", "left").select("id", "name", F.col("name_kana").alias("kana"), "kaiha", F.col("n_speeches").alias("n"))


def name_search(spark, sf_dir):
    return R.match_names(_people_list(spark, sf_dir), "みどり").select("id", "name", "rank")


def name_filter(spark, sf_dir):
    return R.filter_names(_people_list(spark, sf_dir), "ミド リ").select("id", "name")


def name_find(spark, sf_dir):
    return E.find_people(table(spark, sf_dir, "politician"), "Q90000000120").select("id", "name").unionByName(E.find_people(table(spark, sf_dir, "politician"), "ツボクニ").select("id", "name"))


def typed_sort(spark, sf_dir):
    """The first 40 by speeches falling, blanks last, and their places."""
    order = [*R.typed_order("n_speeches", "num"), F.col("id").asc()]
    return table(spark, sf_dir, "politician").orderBy(*order).limit(40).select("id", "n_speeches")


def blank_sort(spark, sf_dir):
    """Places in a text sort of constituencies, blanks last also when it falls."""
    order = [*R.typed_order("district", "text", descending=True), F.col("id").asc()]
    return number_rows(table(spark, sf_dir, "politician").select("id", "district"), order, "place").where("district IS NULL").select("id", "place")


def distinct_speakers(spark, sf_dir):
    return table(spark, sf_dir, "speech").select("speaker").distinct()


def group_set_operations(spark, sf_dir):
    """Groups spoken for, against groups of the map: in both, and only spoken."""
    said, known = members(spark, sf_dir).select("speaker_group").where("speaker_group IS NOT NULL").distinct(), table(spark, sf_dir, "party_map").select("kaiha")
    return said.intersect(known).select("speaker_group", F.lit("both").alias("side")).unionByName(said.exceptAll(known).select("speaker_group", F.lit("spoken").alias("side")))


def fold_bindings(spark, sf_dir):
    a = table(spark, sf_dir, "affiliation").select("politician_id", "id", "kaiha", "party")
    folded = E.fold_bindings(a, "politician_id", "id", ["party"], ["kaiha"])
    return folded.select("politician_id", "party", F.array_join("kaiha", "|").alias("kaiha"))


# --- Products, reports and lists


def front_page(spark, sf_dir):
    topics = topic_table(spark, TOPICS).join(topic_totals(spark, sf_dir).select(F.col("topic_id").alias("id"), "n_speeches"), "id").select("term", "n_speeches")
    words = burst_terms(spark, sf_dir).select("term", "burst", "peak_year")
    return P.front_page(topics, words, trend_windows(spark, sf_dir).select("window", "rank", "term", "n")).withColumn("value", F.round("value", 3))


def product_topics(spark, sf_dir):
    cells = _topic_cells(spark, sf_dir).where("kaiha = '*'").select("topic_id", "month", F.col("n_speeches").alias("n"))
    totals = topic_totals(spark, sf_dir).select("topic_id", "n_speeches")
    return P.as_json(P.topic_product(topic_table(spark, TOPICS), totals, cells, T.axis_months(members(spark, sf_dir))), "id")


def product_trending(spark, sf_dir):
    return P.as_json(P.trend_product(trend_windows(spark, sf_dir)), "window")


def product_activity(spark, sf_dir):
    cells = members(spark, sf_dir).where("politician_id IS NOT NULL").groupBy("politician_id", month_of(F.col("date")).alias("month")).agg(F.count("*").alias("n"))
    return P.as_json(P.activity_product(cells, T.axis_months(members(spark, sf_dir))), "politician_id")


def report_todo(spark, sf_dir):
    return P.todo_report(_matched(spark, sf_dir).na.fill("", ["speaker", "speaker_yomi", "speaker_group"]))


def report_frequent(spark, sf_dir):
    words = burst_terms(spark, sf_dir).withColumnRenamed("peak_year", "peak")
    return P.frequent_report(words)


def people_order(spark, sf_dir):
    """Places of politicians by the number of their speeches, equal ones by reading."""
    people = table(spark, sf_dir, "politician").select("id", F.col("name_kana").alias("kana"), (F.col("n_speeches") % 7).alias("n"))
    return number_rows(people, R.people_order("n", "num"), "place").select("id", "place")


QUERIES = {f.__name__: f for f in (
    standing_terms, pool_frequencies, mining_denominators, term_fragments, near_duplicate_terms, kept_terms, burst_terms, frequent_words, word_years, month_axis, month_starts, word_sessions, proposals, proposal_lists, trend_windows, trend_new_terms, topic_candidates,
    topic_cells, speech_totals, kept_groups, topic_totals, meeting_totals, topic_series, topic_rates, group_rates, topic_stacks, peak_months, sessions, session_lift, activity, activity_top, activity_series, activity_year, corpus_totals,
    units, speaker_stats, entity_match, entity_report, entity_people, entity_ledger, entity_keys, entity_speeches, entity_parties, entity_unresolved, override_recount, override_lost, affiliation_on_date, current_affiliation, group_timeline, name_search, name_filter, name_find, typed_sort, blank_sort, distinct_speakers, group_set_operations, fold_bindings,
    front_page, product_topics, product_trending, product_activity, report_todo, report_frequent, people_order,
)}

# --- SQL

_KNOWN = ", ".join(f"'{f}'" for t in TOPICS for f in (t["term"], *t["variants"]))
_STANDING = f"standing AS (SELECT term, count(*) AS standalone FROM (SELECT DISTINCT period, rowid, {sql_fold('run')} AS term FROM runs WHERE length(run) BETWEEN 2 AND 4) GROUP BY term)"
_CELLS = "cells AS (SELECT w.term, strftime(w.date, '%Y-%m') AS month, g.session, count(*) AS n FROM windows w JOIN meeting g ON g.issue_id = w.issue_id WHERE w.term IN (SELECT term FROM standing WHERE standalone >= CASE WHEN length(term) = 2 THEN 5 ELSE 10 END) GROUP BY ALL)"
_TOTALS = "totals AS (SELECT term, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY term)"
_MINING = [RUNS, _STANDING, _CELLS, _TOTALS]
_PARTS = "parts AS MATERIALIZED (SELECT DISTINCT substr(speaker, CAST(i AS INT), CAST(k AS INT)) AS part FROM (SELECT DISTINCT speaker FROM facts WHERE speaker IS NOT NULL), LATERAL (SELECT unnest(range(2, length(speaker) + 1)) AS k), LATERAL (SELECT unnest(range(1, length(speaker) - k + 2)) AS i))"
_ROLES = "roles AS (SELECT unnest([" + ", ".join(f"'{r}'" for r in M.ROLE_SUFFIXES) + "]) AS role)"


def _keep(source: str) -> str:
    """Terms of a table with a column term that are kept as words."""
    stop = ", ".join(f"'{w}'" for w in (*M.STOPWORDS, *DENIED))
    return f"""(SELECT DISTINCT s.term FROM {source} s WHERE s.term NOT IN ({stop}) AND NOT regexp_matches(s.term, '({"|".join(M.ROLE_ENDINGS)})$') AND NOT regexp_matches(s.term, '{"|".join(M.ROLE_CONTAINS)}') AND NOT regexp_matches(s.term, '{M.ERA_YEAR}')
        AND s.term NOT IN (SELECT part FROM parts) AND NOT EXISTS (SELECT 1 FROM roles WHERE ends_with(s.term, role) AND left(s.term, length(s.term) - length(role)) IN (SELECT part FROM parts)))"""


_NOISE = f"term NOT IN ({', '.join(chr(39) + w + chr(39) for w in M.STOPWORDS)}) AND NOT regexp_matches(term, '{M.NUMERALS_ONLY}') AND NOT regexp_matches(term, '{M.QUANTITY}') AND NOT regexp_matches(term, '^[御ご]')"
_RATES = """
years AS (SELECT year, sum(v) AS v FROM ({volume}) GROUP BY year),
grid AS (SELECT t.term, y.year, coalesce(c.n, 0) AS n, coalesce(c.n, 0) / CAST(y.v AS DOUBLE) * {per} AS rate FROM (SELECT DISTINCT term FROM by_year) t CROSS JOIN years y LEFT JOIN by_year c ON c.term = t.term AND c.year = y.year),
lists AS (SELECT term, CAST(sum(n) AS BIGINT) AS n, list_sort(list(rate)) AS rates, last(rate ORDER BY year) AS latest, first(year ORDER BY rate DESC, year) AS peak_year, CAST(first(n ORDER BY rate DESC, year) AS BIGINT) AS peak_n FROM grid GROUP BY term),
profile AS (SELECT term, n, (rates[-1] + 0.1) / (rates[len(rates) // 2 + 1] + 0.1) AS burst, (latest + 0.1) / (rates[len(rates) // 2 + 1] + 0.1) AS recency, peak_year, peak_n FROM lists)"""
_BURST = "by_year AS (SELECT term, substr(month, 1, 4) AS year, sum(n) AS n FROM cells GROUP BY ALL)," + _RATES.format(volume="SELECT strftime(m.date, '%Y') AS year, 1 AS v FROM members m JOIN meeting g ON g.issue_id = m.issue_id", per=1000)
_CAND = f"cand AS (SELECT date, unnest(regexp_extract_all(body, '{CANDIDATE_PATTERN}')) AS term FROM members)"
_PROPOSE = [_CAND, _PARTS, _ROLES, "by_year AS (SELECT term, strftime(date, '%Y') AS year, count(*) AS n FROM cand GROUP BY ALL)", _RATES.format(volume="SELECT strftime(date, '%Y') AS year, 1 AS v FROM cand", per="1e6"), "picked AS (SELECT * FROM profile WHERE n >= 20 AND term IN " + _keep("(SELECT term FROM profile WHERE n >= 20)") + ")"]
_TREND = [_CAND, _PARTS, _ROLES, """by_date AS (SELECT date, term, count(*) AS n FROM cand GROUP BY ALL), sittings AS (SELECT date, CAST((row_number() OVER (ORDER BY date DESC) - 1) // 5 AS INT) AS "window" FROM (SELECT DISTINCT date FROM by_date)),
    spans AS (SELECT s."window", min(s.date) AS from_date, max(s.date) AS until, count(*) AS sitting_days FROM sittings s WHERE s."window" < 8 GROUP BY 1), volumes AS (SELECT s."window", count(*) AS n_speeches FROM members m JOIN sittings s ON s.date = m.date GROUP BY 1),
    inside AS (SELECT s."window", b.term, CAST(sum(b.n) AS BIGINT) AS n FROM by_date b JOIN sittings s ON s.date = b.date WHERE s."window" < 8 GROUP BY ALL), sums AS (SELECT "window", sum(n) AS total FROM inside GROUP BY 1), base AS (SELECT term, sum(n) AS base FROM by_date GROUP BY term),
    lifted AS (SELECT i."window", i.term, i.n, (i.n / s.total) / ((b.base + 1) / (SELECT CAST(sum(n) AS DOUBLE) FROM by_date)) AS lift FROM inside i JOIN sums s ON s."window" = i."window" JOIN base b ON b.term = i.term WHERE i.n >= 3 AND i.term IN """ + _keep("(SELECT term FROM inside WHERE n >= 3)") + """),
    trend AS (SELECT l."window", p.from_date, p.until, p.sitting_days, v.n_speeches, CAST(row_number() OVER (PARTITION BY l."window" ORDER BY l.lift DESC, l.term) AS INT) AS rank, l.term, l.n, l.lift FROM lifted l JOIN spans p ON p."window" = l."window" JOIN volumes v ON v."window" = l."window" QUALIFY rank <= 20)"""]
_TCELLS = HITS + ", tcells AS (SELECT topic_id, strftime(date, '%Y-%m') AS month, CASE WHEN grouping(kaiha) = 1 THEN '*' ELSE kaiha END AS kaiha, count(*) AS n_speeches, CAST(sum(n) AS BIGINT) AS n_occurrences FROM hits GROUP BY GROUPING SETS ((topic_id, strftime(date, '%Y-%m')), (topic_id, strftime(date, '%Y-%m'), kaiha)))"
_STOTALS = "stotals AS (SELECT month, CASE WHEN grouping(kaiha) = 1 THEN '*' ELSE kaiha END AS kaiha, count(*) AS total FROM (SELECT strftime(date, '%Y-%m') AS month, coalesce(speaker_group, '') AS kaiha FROM members) GROUP BY GROUPING SETS ((month), (month, kaiha)))"
_KEPT = "kept AS (SELECT kaiha, CAST(sum(total) AS BIGINT) AS volume FROM stotals WHERE kaiha NOT IN ('*', '') GROUP BY kaiha HAVING sum(total) >= 150)"
_ACT = "act AS (SELECT m.politician_id, g.name, strftime(m.date, '%Y-%m') AS month, count(*) AS n FROM members m JOIN meeting g ON g.issue_id = m.issue_id WHERE m.politician_id IS NOT NULL GROUP BY ALL)"
_SESS = "sess AS (SELECT g.session, min(m.date) AS first, max(m.date) AS last, count(*) AS n_speeches FROM members m JOIN meeting g ON g.issue_id = m.issue_id GROUP BY g.session HAVING count(*) >= 200)"
_UNITS = "units AS (SELECT f.speaker, f.speaker_yomi, f.speaker_group, count(*) AS n_speeches, min(f.date) AS first_date, max(f.date) AS last_date, string_agg(DISTINCT g.house, ',' ORDER BY g.house) AS houses FROM facts f JOIN meeting g ON g.issue_id = f.issue_id WHERE f.speaker_kind = '議員' GROUP BY ALL)"
_PEOPLE_LIST = "cur AS (SELECT politician_id, id, kaiha, party FROM affiliation QUALIFY row_number() OVER (PARTITION BY politician_id ORDER BY coalesce(end_date, DATE '9999-12-31') DESC, id DESC) = 1), list AS (SELECT p.id, p.name, p.name_kana AS kana, c.kaiha, p.n_speeches AS n FROM politician p LEFT JOIN cur c ON c.politician_id = p.id)"
_FOLD = lambda c: sql_hiragana(f"regexp_replace({c}, '[\\s　]', '', 'g')")
_AXIS = "axis AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS k FROM (SELECT DISTINCT strftime(date, '%Y-%m') AS month FROM members))"
_OVER = [_UNITS, "big AS (SELECT * FROM units WHERE n_speeches >= 10)", """ospans AS (SELECT speaker, speaker_yomi, speaker_group, 1 AS seq, '甲' AS party, first_date AS a, DATE '2022-12-31' AS b FROM big UNION ALL SELECT speaker, speaker_yomi, speaker_group, 2, NULL, DATE '2023-01-01', DATE '2024-06-30' FROM big UNION ALL SELECT speaker, speaker_yomi, speaker_group, 3, '乙', DATE '2024-08-01', last_date FROM big)""",
    "recounted AS (SELECT o.speaker, o.speaker_yomi, o.speaker_group, o.seq, o.party, count(*) AS n_speeches, min(m.date) AS start_date, max(m.date) AS end_date FROM ospans o JOIN members m ON m.speaker IS NOT DISTINCT FROM o.speaker AND m.speaker_yomi IS NOT DISTINCT FROM o.speaker_yomi AND m.speaker_group IS NOT DISTINCT FROM o.speaker_group AND m.date BETWEEN o.a AND o.b GROUP BY ALL)"]

_MATCH = [_UNITS, f"""u AS (SELECT row_number() OVER () AS unit, *, {sql_name_key('speaker')} AS uname, nullif({sql_name_key('speaker_yomi')}, '') AS ukana, (SELECT list_transform(parties, lambda p: {sql_name_key('p')}) FROM party_map q WHERE q.kaiha = units.speaker_group) AS allowed FROM units)""",
    f"""kb AS (SELECT p.wikidata_id, nullif({sql_name_key('p.name_kana')}, '') AS kkana, CASE WHEN regexp_matches(p.name, '[぀-ヿ一-鿿]') THEN {sql_name_key('p.name')} END AS kname, CASE WHEN p.house IS NULL THEN [] ELSE [p.house] END AS khouses,
        coalesce((SELECT list(DISTINCT {sql_name_key('a.party')}) FROM affiliation a WHERE a.politician_id = p.id AND a.party IS NOT NULL), []) AS kparties, p.id FROM politician p WHERE p.wikidata_id IS NOT NULL)""",
    """pairs AS (SELECT u.unit, 'reading' AS route, kb.*, u.* EXCLUDE unit FROM u JOIN kb ON kb.kkana = u.ukana UNION ALL SELECT u.unit, 'name', kb.*, u.* EXCLUDE unit FROM u JOIN kb ON kb.kname = u.uname WHERE u.ukana IS NULL OR u.ukana NOT IN (SELECT kkana FROM kb WHERE kkana IS NOT NULL)),
    s1 AS (SELECT *, coalesce(kname = uname, false) AS h1, coalesce(list_has_any(allowed, kparties), false) AS h2, coalesce(list_has_any(list_filter(string_split(houses, ','), lambda h: h NOT IN ('', '両院')), khouses), false) AS h3,
        EXISTS (SELECT 1 FROM affiliation a WHERE a.politician_id = pairs.id AND a.start_date <= last_date AND first_date <= coalesce(a.end_date, DATE '9999-12-31')) AS h4, count(*) OVER (PARTITION BY unit) AS n0 FROM pairs),
    s2 AS (SELECT *, sum(h1::INT) OVER (PARTITION BY unit) AS c1 FROM s1), s3 AS (SELECT *, CASE WHEN n0 > 1 AND c1 > 0 THEN h1 ELSE true END AS in1, n0 > 1 AND c1 <> 1 AS open1 FROM s2),
    s4 AS (SELECT *, sum((in1 AND h2)::INT) OVER (PARTITION BY unit) AS c2 FROM s3), s5 AS (SELECT *, CASE WHEN open1 AND c2 > 0 THEN in1 AND h2 ELSE in1 END AS in2, open1 AND c2 <> 1 AS open2 FROM s4),
    s6 AS (SELECT *, sum((in2 AND h3)::INT) OVER (PARTITION BY unit) AS c3 FROM s5), s7 AS (SELECT *, CASE WHEN open2 AND c3 > 0 THEN in2 AND h3 ELSE in2 END AS in3, open2 AND c3 <> 1 AS open3 FROM s6),
    s8 AS (SELECT *, sum((in3 AND h4)::INT) OVER (PARTITION BY unit) AS c4 FROM s7), s9 AS (SELECT *, CASE WHEN open3 AND c4 = 1 THEN in3 AND h4 ELSE in3 END AS in4, CASE WHEN n0 = 1 THEN NULL WHEN c1 = 1 THEN 'exact name' WHEN c2 = 1 THEN 'party' WHEN c3 = 1 THEN 'house' WHEN c4 = 1 THEN 'term' ELSE 'undecided' END AS how FROM s8),
    best AS (SELECT unit, any_value(route) AS route, any_value(how) AS narrowed_by, CAST(sum(in4::INT) AS BIGINT) AS n_candidates, min(wikidata_id) FILTER (in4) AS qid FROM s9 GROUP BY unit),
    matched AS (SELECT u.speaker, u.speaker_yomi, u.speaker_group, u.n_speeches, u.first_date, u.last_date, u.houses, coalesce(b.route, 'none') AS route, b.narrowed_by, coalesce(b.n_candidates, 0) AS n_candidates, CASE WHEN b.n_candidates = 1 THEN qid END AS wikidata_id FROM u LEFT JOIN best b ON b.unit = u.unit)"""]  # fmt: skip
_ASSIGNED = f"""placed AS (SELECT *, 'local:' || {sql_name_key('name')} || ':' || coalesce({sql_name_key('name_kana')}, '') AS local, row_number() OVER (ORDER BY n_speeches DESC, person_key) AS seq FROM persons),
    claims AS (SELECT *, row_number() OVER w AS place, coalesce(bool_or(wikidata_id IS NOT NULL) OVER (PARTITION BY local ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM placed WINDOW w AS (PARTITION BY local ORDER BY seq)),
    given AS (SELECT *, CASE WHEN place = 1 OR ended THEN sum(CASE WHEN place = 1 OR ended THEN 1 ELSE 0 END) OVER (ORDER BY seq) END AS new FROM claims),
    assigned AS (SELECT *, CAST(coalesce(new, first_value(new) OVER (PARTITION BY local ORDER BY seq)) AS BIGINT) AS id FROM given)"""
_PEOPLE = [*_MATCH, f"""keyed AS (SELECT *, coalesce(wikidata_id, 'local:' || {sql_name_key('speaker')} || ':' || coalesce({sql_name_key('speaker_yomi')}, '')) AS person_key FROM matched),
    spelt AS (SELECT person_key, speaker AS name FROM keyed WHERE speaker IS NOT NULL GROUP BY person_key, speaker QUALIFY row_number() OVER (PARTITION BY person_key ORDER BY sum(n_speeches) DESC, speaker) = 1),
    sounded AS (SELECT person_key, speaker_yomi AS name_kana FROM keyed WHERE speaker_yomi IS NOT NULL GROUP BY person_key, speaker_yomi QUALIFY row_number() OVER (PARTITION BY person_key ORDER BY sum(n_speeches) DESC, speaker_yomi) = 1),
    persons AS (SELECT k.person_key, max(k.wikidata_id) AS wikidata_id, any_value(s.name) AS name, any_value(o.name_kana) AS name_kana, CAST(sum(k.n_speeches) AS BIGINT) AS n_speeches, min(k.first_date) AS first_date, max(k.last_date) AS last_date FROM keyed k LEFT JOIN spelt s USING (person_key) LEFT JOIN sounded o USING (person_key) GROUP BY k.person_key)"""]
_PARTY = [*_MATCH, f"""rowsp AS (SELECT m.speaker, m.speaker_yomi, m.speaker_group AS kaiha, m.n_speeches, m.wikidata_id, q.parties AS maybe, k.kparties FROM matched m LEFT JOIN party_map q ON q.kaiha = m.speaker_group LEFT JOIN kb k ON k.wikidata_id = m.wikidata_id),
    overl AS (SELECT *, list_filter(maybe, lambda p: list_contains(kparties, {sql_name_key('p')})) AS o FROM rowsp),
    resolved AS (SELECT speaker, speaker_yomi, kaiha, n_speeches, wikidata_id, CASE WHEN coalesce(len(maybe), 0) = 1 THEN maybe[1] WHEN coalesce(len(maybe), 0) > 1 AND len(o) = 1 THEN o[1] END AS party,
        CASE WHEN coalesce(len(maybe), 0) = 0 THEN 'no candidate' WHEN len(maybe) = 1 THEN NULL WHEN wikidata_id IS NULL THEN 'unmatched' WHEN len(kparties) = 0 THEN 'no party known' WHEN len(o) = 1 THEN NULL WHEN len(o) = 0 THEN 'no overlap' ELSE 'several overlap' END AS why FROM overl)"""]

ORACLES = {
    "entity_match": with_facts(" SELECT * FROM matched", *_MATCH),
    "entity_report": with_facts(", b AS (SELECT route, coalesce(narrowed_by, '') AS narrowed_by, CASE WHEN n_candidates = 0 THEN 'none' WHEN n_candidates = 1 THEN 'matched' ELSE 'several' END AS status, count(*) AS units, CAST(sum(n_speeches) AS BIGINT) AS speeches FROM matched GROUP BY ALL) SELECT *, round(speeches * 100 / sum(speeches) OVER (), 2) AS percent FROM b", *_MATCH),
    "entity_ledger": with_facts(" SELECT person_key, id FROM assigned", *_PEOPLE, _ASSIGNED),
    "entity_keys": with_facts(" SELECT wikidata_id AS key, id FROM assigned WHERE wikidata_id IS NOT NULL UNION ALL SELECT local, id FROM assigned WHERE place = 1", *_PEOPLE, _ASSIGNED),
    "entity_speeches": with_facts(" SELECT m.row_id, a.id AS person_id FROM members m LEFT JOIN keyed k ON m.speaker IS NOT DISTINCT FROM k.speaker AND m.speaker_yomi IS NOT DISTINCT FROM k.speaker_yomi AND m.speaker_group IS NOT DISTINCT FROM k.speaker_group LEFT JOIN assigned a ON a.person_key = k.person_key", *_PEOPLE, _ASSIGNED),
    "entity_people": with_facts(" SELECT *, CAST(row_number() OVER (ORDER BY n_speeches DESC, person_key) AS INT) AS seq FROM persons", *_PEOPLE),
    "entity_parties": with_facts(" SELECT * FROM resolved", *_PARTY),
    "entity_unresolved": with_facts(" SELECT kaiha, why, count(*) AS affiliations, CAST(sum(n_speeches) AS BIGINT) AS speeches FROM resolved WHERE party IS NULL GROUP BY ALL", *_PARTY),
    "standing_terms": with_facts(" SELECT * FROM standing", RUNS, _STANDING),
    "pool_frequencies": with_facts(" SELECT * FROM cells", *_MINING),
    "mining_denominators": with_facts(" SELECT strftime(m.date, '%Y-%m') AS month, g.session, count(*) AS n_speeches, min(m.date) AS first, max(m.date) AS last FROM members m JOIN meeting g ON g.issue_id = m.issue_id GROUP BY 1, 2"),
    "term_fragments": with_facts(f" SELECT t.term FROM (SELECT term, count(*) AS n FROM windows WHERE length(term) = 2 GROUP BY term) t LEFT JOIN standing s ON s.term = t.term WHERE t.term >= 'Ａ' AND coalesce(s.standalone, 0) / t.n < 0.5", RUNS, _STANDING),
    "near_duplicate_terms": with_facts(" SELECT DISTINCT a.term FROM totals a JOIN totals b ON length(b.term) > length(a.term) AND contains(b.term, a.term) WHERE b.n >= a.n * 0.75", *_MINING),
    "kept_terms": with_facts(f" SELECT term, n FROM totals WHERE {_NOISE} AND term IN {_keep('totals')}", *_MINING, _PARTS, _ROLES),
    "burst_terms": with_facts(" SELECT term, n, round(burst, 6) AS burst, round(recency, 6) AS recency, peak_year, peak_n FROM profile WHERE n >= 20", *_MINING, _BURST),
    "frequent_words": with_facts(f""", eligible AS (SELECT term, n, burst FROM profile WHERE n >= 20 AND {_NOISE} AND term IN {_keep('totals')} AND term NOT IN (SELECT t.term FROM totals t LEFT JOIN standing s ON s.term = t.term WHERE length(t.term) = 2 AND t.term >= 'Ａ' AND coalesce(s.standalone, 0) / t.n < 0.5)),
        head AS (SELECT * FROM eligible ORDER BY burst DESC, term LIMIT 150), words AS (SELECT * FROM head a WHERE NOT EXISTS (SELECT 1 FROM head b WHERE length(b.term) > length(a.term) AND contains(b.term, a.term) AND b.n >= a.n * 0.75) ORDER BY burst DESC, term LIMIT 50),
        months AS (SELECT strftime(m.date, '%Y-%m') AS month, CAST(count(*) AS DOUBLE) AS v FROM members m JOIN meeting g ON g.issue_id = m.issue_id GROUP BY 1), monthly AS (SELECT term, month, sum(n) AS k FROM cells GROUP BY ALL)
        SELECT w.term, w.n, round(w.burst, 6) AS burst, (SELECT first(m.month ORDER BY m.k / v.v DESC, m.month) FROM monthly m JOIN months v ON v.month = m.month WHERE m.term = w.term) AS peak FROM words w""", *_MINING, _PARTS, _ROLES, _BURST),
    "word_years": with_facts(f""", eligible AS (SELECT term, n, burst FROM profile WHERE n >= 20 AND {_NOISE} AND term IN {_keep('totals')} AND term NOT IN (SELECT t.term FROM totals t LEFT JOIN standing s ON s.term = t.term WHERE length(t.term) = 2 AND t.term >= 'Ａ' AND coalesce(s.standalone, 0) / t.n < 0.5)),
        head AS (SELECT * FROM eligible ORDER BY burst DESC, term LIMIT 150), words AS (SELECT * FROM head a WHERE NOT EXISTS (SELECT 1 FROM head b WHERE length(b.term) > length(a.term) AND contains(b.term, a.term) AND b.n >= a.n * 0.75) ORDER BY burst DESC, term LIMIT 50),
        months AS (SELECT strftime(m.date, '%Y-%m') AS month, CAST(count(*) AS DOUBLE) AS v FROM members m JOIN meeting g ON g.issue_id = m.issue_id GROUP BY 1), monthly AS (SELECT term, month, sum(n) AS k FROM cells GROUP BY ALL)
        SELECT substr(peak, 1, 4) AS year, count(*) AS n, string_agg(term, ',' ORDER BY term) AS terms FROM (SELECT w.term, (SELECT first(m.month ORDER BY m.k / v.v DESC, m.month) FROM monthly m JOIN months v ON v.month = m.month WHERE m.term = w.term) AS peak FROM words w) GROUP BY 1""", *_MINING, _PARTS, _ROLES, _BURST),
    "month_axis": with_facts(" SELECT DISTINCT strftime(date, '%Y-%m') AS month FROM members WHERE date BETWEEN DATE '2022-01-01' AND DATE '2024-12-31'"),
    "month_starts": with_facts(", p AS (SELECT DISTINCT period FROM facts), c AS (SELECT period, substr(period, 1, 4) || '-' || lpad(CAST(i + CASE WHEN ends_with(period, '2') THEN 6 ELSE 0 END AS VARCHAR), 2, '0') AS month FROM p, (SELECT unnest(range(1, 7)) AS i)) SELECT c.period, c.month, coalesce((SELECT min(rowid) FROM facts f WHERE f.period = c.period AND strftime(f.date, '%Y-%m') = c.month), 9007199254740991) AS first FROM c"),
    "word_sessions": with_facts(" SELECT term, session, CAST(sum(n) AS BIGINT) AS hits FROM cells WHERE term IN (SELECT term FROM totals ORDER BY n DESC, term LIMIT 30) GROUP BY ALL", *_MINING),
    "proposals": with_facts(" SELECT term, n, round(burst, 6) AS burst, round(recency, 6) AS recency, peak_year, peak_n, peak_n >= 8 AS burstable FROM picked", *_PROPOSE),
    "proposal_lists": with_facts(""" SELECT * FROM (
        SELECT 'burst' AS list, CAST(row_number() OVER (ORDER BY burst DESC, term) AS INT) AS rank, term FROM picked WHERE peak_n >= 8 QUALIFY rank <= 40
        UNION ALL SELECT 'current', CAST(row_number() OVER (ORDER BY recency DESC, term) AS INT) AS rank, term FROM picked WHERE peak_n >= 8 AND peak_year = (SELECT max(peak_year) FROM picked) QUALIFY rank <= 20
        UNION ALL SELECT 'frequent', CAST(row_number() OVER (ORDER BY n DESC, term) AS INT) AS rank, term FROM picked QUALIFY rank <= 30)""", *_PROPOSE),
    "trend_windows": with_facts(' SELECT "window", from_date, until, sitting_days, n_speeches, rank, term, n, round(lift, 6) AS lift FROM trend', *_TREND),
    "trend_new_terms": with_facts(f" SELECT term, CAST(sum(n) AS BIGINT) AS n, round(max(lift), 6) AS lift, string_agg(strftime(from_date, '%Y-%m-%d'), '/' ORDER BY from_date) AS windows FROM trend WHERE term NOT IN ({_KNOWN}) GROUP BY term", *_TREND),
    "topic_candidates": with_facts(f""", pool AS (SELECT term, 0 AS source, max(lift) AS score FROM trend GROUP BY term UNION ALL SELECT term, 1, round(burst, 6) FROM (SELECT p2.term, p2.burst FROM profile p2 WHERE p2.n >= 20)), firsts AS (SELECT term, source, score FROM pool WHERE term NOT IN ({_KNOWN}) QUALIFY row_number() OVER (PARTITION BY term ORDER BY source, score DESC) = 1)
        SELECT term, source, round(score, 5) AS score FROM firsts ORDER BY source, score DESC, term LIMIT 60""", *_TREND, *_MINING, _BURST),
    "topic_cells": with_facts(" SELECT * FROM tcells", _TCELLS),
    "speech_totals": with_facts(" SELECT * FROM stotals", _STOTALS),
    "kept_groups": with_facts(" SELECT * FROM kept", _STOTALS, _KEPT),
    "topic_totals": with_facts(" SELECT topic_id, CAST(sum(n_speeches) AS BIGINT) AS n_speeches, CAST(sum(n_occurrences) AS BIGINT) AS n_occurrences FROM tcells WHERE kaiha = '*' GROUP BY topic_id", _TCELLS),
    "meeting_totals": with_facts(" SELECT g.name, strftime(m.date, '%Y-%m') AS month, count(*) AS n FROM members m JOIN meeting g ON g.issue_id = m.issue_id GROUP BY ALL"),
    "topic_series": with_facts(" SELECT t.topic_id, string_agg(CAST(coalesce(c.n_speeches, 0) AS VARCHAR), ',' ORDER BY a.month) AS series FROM (SELECT DISTINCT topic_id FROM tcells) t CROSS JOIN axis a LEFT JOIN tcells c ON c.topic_id = t.topic_id AND c.month = a.month AND c.kaiha = '*' GROUP BY t.topic_id", _TCELLS, _AXIS),
    "topic_rates": with_facts(" SELECT c.topic_id, c.month, c.kaiha, c.n_speeches, c.n_occurrences, t.total, c.n_speeches / t.total * 1000 AS rate, t.total < 100 AS low_support FROM tcells c JOIN stotals t ON t.month = c.month AND t.kaiha = c.kaiha", _TCELLS, _STOTALS),
    "group_rates": with_facts(", r AS (SELECT c.topic_id, c.kaiha, CAST(sum(c.n_speeches) AS BIGINT) AS hits, any_value(k.volume) AS total, sum(c.n_speeches) / any_value(k.volume) * 1000 AS rate FROM tcells c JOIN kept k ON k.kaiha = c.kaiha GROUP BY ALL) SELECT *, round(rate * 100 / max(rate) OVER (PARTITION BY topic_id), 1) AS share FROM r", _TCELLS, _STOTALS, _KEPT),
    "topic_stacks": with_facts(" SELECT topic_id, month, CAST(sum(n_speeches) AS BIGINT) AS height, max(n_speeches) AS largest FROM tcells WHERE kaiha <> '*' GROUP BY ALL", _TCELLS),
    "peak_months": with_facts(" SELECT topic_id, month, rate FROM (SELECT c.topic_id, c.month, c.n_speeches / t.total * 1000 AS rate FROM tcells c JOIN stotals t ON t.month = c.month AND t.kaiha = c.kaiha WHERE c.kaiha = '*') QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY rate DESC, month) = 1", _TCELLS, _STOTALS),
    "sessions": with_facts(" SELECT s.session, s.first, s.last, s.n_speeches, (SELECT count(*) FROM meeting g WHERE g.session = s.session) AS n_meetings, coalesce(lag(s.session) OVER (ORDER BY s.session), 0) AS before, coalesce(lead(s.session) OVER (ORDER BY s.session), 0) AS after FROM sess s", _SESS),
    "session_lift": with_facts(", h AS (SELECT term, session, sum(n) AS hits FROM cells WHERE term IN (SELECT term FROM totals WHERE n >= 20) GROUP BY ALL HAVING sum(n) >= 5), l AS (SELECT h.session, h.term, CAST(h.hits AS BIGINT) AS hits, (h.hits / s.n_speeches) / (t.n / (SELECT CAST(count(*) AS DOUBLE) FROM members)) AS lift FROM h JOIN sess s ON s.session = h.session JOIN totals t ON t.term = h.term) SELECT session, term, hits, round(lift, 6) AS lift, CAST(row_number() OVER (PARTITION BY session ORDER BY lift DESC, hits DESC, term) AS INT) AS rank FROM l", *_MINING, _SESS),
    "activity": with_facts(" SELECT * FROM act", _ACT),
    "activity_top": with_facts(", r AS (SELECT politician_id, name, row_number() OVER (PARTITION BY politician_id ORDER BY sum(n) DESC, name) AS k FROM act GROUP BY politician_id, name) SELECT a.politician_id, CASE WHEN r.k <= 7 THEN a.name ELSE 'その他' END AS name, a.month, CAST(sum(a.n) AS BIGINT) AS n FROM act a JOIN r ON r.politician_id = a.politician_id AND r.name = a.name GROUP BY ALL", _ACT),
    "activity_series": with_facts(", c AS (SELECT politician_id, strftime(date, '%Y-%m') AS month, count(*) AS n FROM members WHERE politician_id IS NOT NULL GROUP BY ALL) SELECT p.politician_id, string_agg(CAST(coalesce(c.n, 0) AS VARCHAR), ',' ORDER BY a.month) AS series FROM (SELECT DISTINCT politician_id FROM c) p CROSS JOIN axis a LEFT JOIN c ON c.politician_id = p.politician_id AND c.month = a.month GROUP BY p.politician_id", _AXIS),
    "activity_year": with_facts(" SELECT * FROM act WHERE substr(month, 1, 4) = '2024'", _ACT),
    "corpus_totals": with_facts(" SELECT (SELECT count(DISTINCT politician_id) FROM members) AS people, (SELECT count(*) FROM members WHERE politician_id IS NOT NULL) AS speeches, (SELECT period FROM facts GROUP BY period ORDER BY count(*) DESC, period DESC LIMIT 1) AS largest_period, (SELECT max(date) FROM facts) AS until"),
    "units": with_facts(" SELECT * FROM units", _UNITS),
    "speaker_stats": f"WITH {FACTS} SELECT speaker, speaker_kind, count(*) AS n_speeches, min(date) AS first_date, max(date) AS last_date FROM facts GROUP BY ALL",
    "override_recount": with_facts(" SELECT * FROM recounted", *_OVER),
    "override_lost": with_facts(" SELECT b.speaker, b.speaker_yomi, b.speaker_group, b.n_speeches AS in_all, CAST(sum(r.n_speeches) AS BIGINT) AS in_parts FROM big b JOIN recounted r ON r.speaker IS NOT DISTINCT FROM b.speaker AND r.speaker_yomi IS NOT DISTINCT FROM b.speaker_yomi AND r.speaker_group IS NOT DISTINCT FROM b.speaker_group GROUP BY ALL HAVING b.n_speeches <> sum(r.n_speeches)", *_OVER),
    "affiliation_on_date": with_facts(" SELECT m.row_id, coalesce(a.id, 0) AS affiliation_id, a.kaiha, a.party FROM members m LEFT JOIN affiliation a ON a.politician_id = m.politician_id AND m.date BETWEEN a.start_date AND coalesce(a.end_date, DATE '9999-12-31') WHERE m.politician_id IS NOT NULL"),
    "current_affiliation": f"WITH {_PEOPLE_LIST} SELECT politician_id, id, kaiha, party FROM cur",
    "group_timeline": "SELECT id, kaiha, party, start_date, end_date FROM affiliation WHERE politician_id = 1",
    "name_search": f"WITH {_PEOPLE_LIST}, r AS (SELECT *, CASE WHEN {_FOLD('name')} = 'みどり' THEN 0 WHEN starts_with({_FOLD('name')}, 'みどり') THEN 1 WHEN contains({_FOLD('name')}, 'みどり') THEN 2 WHEN starts_with({_FOLD('kana')}, 'みどり') THEN 3 WHEN contains({_FOLD('kana')}, 'みどり') THEN 4 WHEN contains({_FOLD('kaiha')}, 'みどり') THEN 5 END AS rank FROM list) SELECT id, name, rank FROM r WHERE rank IS NOT NULL",
    "name_filter": f"WITH {_PEOPLE_LIST} SELECT id, name FROM list WHERE contains({_FOLD(chr(99) + 'oncat_ws(chr(124), name, kana, kaiha)')}, 'みどり')",
    "name_find": "SELECT id, name FROM politician WHERE wikidata_id = 'Q90000000120' UNION ALL SELECT id, name FROM politician WHERE contains(" + sql_hiragana("regexp_replace(name_kana, '[\\s　・]', '', 'g')") + ", 'つぼくに')",
    "typed_sort": "SELECT id, n_speeches FROM politician ORDER BY n_speeches IS NULL, n_speeches DESC, id LIMIT 40",
    "blank_sort": "SELECT id, CAST((SELECT count(*) FROM politician WHERE district IS NOT NULL) + row_number() OVER (ORDER BY id) AS INT) AS place FROM politician WHERE district IS NULL",
    "distinct_speakers": "SELECT DISTINCT speaker FROM speech",
    "group_set_operations": with_facts(", s AS (SELECT DISTINCT speaker_group FROM members WHERE speaker_group IS NOT NULL) SELECT speaker_group, CASE WHEN speaker_group IN (SELECT kaiha FROM party_map) THEN 'both' ELSE 'spoken' END AS side FROM s"),
    "fold_bindings": """WITH seen AS (SELECT politician_id, kaiha, min(id) AS k FROM affiliation WHERE kaiha IS NOT NULL AND kaiha <> '' GROUP BY ALL), lists AS (SELECT politician_id, string_agg(kaiha, '|' ORDER BY k) AS kaiha FROM seen GROUP BY politician_id)
SELECT a.politician_id, first(a.party ORDER BY a.id) FILTER (a.party IS NOT NULL AND a.party <> '') AS party, coalesce(any_value(l.kaiha), '') AS kaiha FROM affiliation a LEFT JOIN lists l ON l.politician_id = a.politician_id GROUP BY a.politician_id""",
}

_NOTED = ", ".join(f"({t['id']}, '{t['term']}', '{t['category']}', [{', '.join(repr(v) for v in t['variants'])}]::VARCHAR[])" for t in TOPICS)
ORACLES |= {
    "front_page": f"""
        WITH t AS (SELECT v.term, CAST(x.n_speeches AS DOUBLE) AS value, 0 AS r FROM ({ORACLES['topic_totals']}) x JOIN (VALUES {_NOTED}) v(id, term, category, variants) ON v.id = x.topic_id),
        b AS (SELECT * FROM ({ORACLES['burst_terms']})), c AS (SELECT term, CAST(burst AS DOUBLE) AS value, 0 AS r FROM b WHERE peak_year = (SELECT max(peak_year) FROM b)),
        w AS (SELECT term, CAST(n AS DOUBLE) AS value, rank AS r FROM ({ORACLES['trend_windows']}) WHERE "window" = 0),
        a AS (SELECT 'topics' AS list, *, 12 AS most FROM t UNION ALL SELECT 'current', *, 12 FROM c UNION ALL SELECT 'trending', *, 14 FROM w)
        SELECT list, CAST(row_number() OVER (PARTITION BY list ORDER BY r, value DESC, term) AS INT) AS place, term, round(value, 3) AS value FROM a QUALIFY place <= most""",
    "product_topics": f"""
        SELECT CAST(v.id AS VARCHAR) AS key, CAST(to_json({{'id': v.id, 'term': v.term, 'category': v.category, 'variants': v.variants, 'n_speeches': coalesce(x.n_speeches, 0), 'months': coalesce(CAST(string_split(s.series, ',') AS BIGINT[]), (SELECT list(0) FROM (SELECT unnest(string_split((SELECT any_value(series) FROM ({ORACLES['topic_series']})), ',')))))}}) AS VARCHAR) AS value
        FROM (VALUES {_NOTED}) v(id, term, category, variants) LEFT JOIN ({ORACLES['topic_totals']}) x ON x.topic_id = v.id LEFT JOIN ({ORACLES['topic_series']}) s ON s.topic_id = v.id""",
    "product_trending": f"""
        SELECT CAST("window" AS VARCHAR) AS key, CAST(to_json({{'window': "window", 'from': strftime(from_date, '%Y-%m-%d'), 'until': strftime("until", '%Y-%m-%d'), 'sitting_days': sitting_days, 'n_speeches': n_speeches, 'terms': list({{'term': term, 'n': n}} ORDER BY rank)}}) AS VARCHAR) AS value
        FROM ({ORACLES['trend_windows']}) GROUP BY "window", from_date, "until", sitting_days, n_speeches""",
    "product_activity": with_facts(""" SELECT CAST(politician_id AS VARCHAR) AS key, CAST(to_json({'politician_id': politician_id, 'n_speeches': CAST(sum(n) AS BIGINT), 'series': flatten(list([k, n] ORDER BY k))}) AS VARCHAR) AS value
        FROM (SELECT m.politician_id, a.k, count(*) AS n FROM members m JOIN axis a ON a.month = strftime(m.date, '%Y-%m') WHERE m.politician_id IS NOT NULL GROUP BY ALL) GROUP BY politician_id""", _AXIS),
    "report_todo": f"""
        WITH u AS (SELECT coalesce(speaker, '') AS a, coalesce(speaker_yomi, '') AS b, coalesce(speaker_group, '') AS c, n_candidates, n_speeches FROM ({ORACLES['entity_match']}) WHERE n_candidates <> 1)
        SELECT 0 AS section, CAST(row_number() OVER (ORDER BY n_speeches DESC, a, b, c) + 3 AS INT) AS place, '| ' || a || ' | ' || b || ' | ' || c || ' | ' || n_candidates || ' | ' || n_speeches || ' |' AS line FROM u
        UNION ALL SELECT * FROM (VALUES (0, 0, '# To do'), (0, 1, '## Unmatched units'), (0, 2, '| speaker | speaker_yomi | speaker_group | n_candidates | n_speeches |'), (0, 3, '|---|---|---|---|---|'))""",
    "report_frequent": f"""
        SELECT 0 AS section, CAST(row_number() OVER (ORDER BY n DESC, term) + 3 AS INT) AS place, '| ' || term || ' | ' || n || ' | ' || peak_year || ' |' AS line FROM ({ORACLES['burst_terms']})
        UNION ALL SELECT * FROM (VALUES (0, 0, '# Frequent words'), (0, 1, '## Words'), (0, 2, '| term | n | peak |'), (0, 3, '|---|---|---|'))""",
    "people_order": "SELECT id, row_number() OVER (ORDER BY n_speeches % 7 DESC NULLS LAST, CASE WHEN trim(coalesce(name_kana, '')) = '' THEN 1 ELSE 0 END, name_kana COLLATE ja, id) AS place FROM politician",
}
