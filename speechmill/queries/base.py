"""Tables and SQL that the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import ASCII_ALNUM, BLANKS, HIRAGANA, INVISIBLE, KATAKANA, RUN_PATTERN, SINGLE, VOICED, WIDE_ALNUM, WIDE_LOWER, WIDE_UPPER
from ..operators.facts import latest_rows, number_in_periods, period_stats
from ..operators.postings import bigram_postings, document_frequency, letter_postings, posting_lists, topic_postings
from ..operators.quality import month_bounds
from ..plans.search import Index, population
from ..session import table
from ..sources.store import stored

#: Topics of the queries, invented for the test corpus.
TOPICS = [
    {"id": 1, "term": "データ", "category": "技術", "variants": ["デジタル"], "indexed": True},
    {"id": 2, "term": "エネルギー", "category": "経済", "variants": [], "indexed": True},
    {"id": 3, "term": "年金", "category": "福祉", "variants": ["年金制度"], "indexed": True},
    {"id": 4, "term": "老朽化", "category": "基盤", "variants": [], "indexed": True},
    {"id": 5, "term": "ＡＩ", "category": "技術", "variants": ["ＤＸ"], "indexed": False},
    {"id": 6, "term": "道路", "category": "基盤", "variants": ["歩道"], "indexed": True},
    {"id": 7, "term": "月面基地", "category": "技術", "variants": [], "indexed": True},
]


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest speeches with their row ids, written once, partitioned by period."""
    return stored(spark, "facts", sf_dir, lambda: number_in_periods(latest_rows(table(spark, sf_dir, "speech"), "speech_id", "fetched_at", "row_id")[0]), "period", ["rowid"])


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population(facts(spark, sf_dir))


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "meeting")


def bigram_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(period, term, n_speeches), written once."""
    return stored(spark, "bigram_df", sf_dir, lambda: document_frequency(bigram_postings(members(spark, sf_dir), ["period"]), ["period", "term"]), "period", ["term"])


def index(spark: SparkSession, sf_dir: str) -> Index:
    """Everything that searches look up, written once."""
    keep = ["period", "rowid"]
    lists = {name: stored(spark, name, sf_dir, lambda build=build: posting_lists(build(members(spark, sf_dir), keep)), "period", ["term"]) for name, build in (("pairs", bigram_postings), ("letters", letter_postings))}
    topics = stored(spark, "topics", sf_dir, lambda: topic_postings(members(spark, sf_dir), TOPICS, keep), "period", ["topic_id", "rowid"])
    return Index(lists["pairs"], lists["letters"], topics, bigram_df(spark, sf_dir), stored(spark, "bounds", sf_dir, lambda: month_bounds(facts(spark, sf_dir))))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_stats(facts(spark, sf_dir), meetings(spark, sf_dir))


def sql_fold(c: str) -> str:
    return f"translate({c}, '{WIDE_LOWER}', '{WIDE_UPPER}')"


def sql_wide(c: str) -> str:
    return f"translate({c}, '{ASCII_ALNUM}', '{WIDE_ALNUM}')"


def sql_hiragana(c: str) -> str:
    return f"translate({c}, '{KATAKANA}', '{HIRAGANA}')"


def sql_name_key(c: str) -> str:
    """name_key, for DuckDB."""
    for pair, whole in VOICED.items():
        c = f"replace({c}, '{pair}', '{whole}')"
    printable = "".join(map(chr, range(0x21, 0x7F)))
    blanks = BLANKS.replace("　", "")
    wide = "".join(chr(ord(x) + 0xFEE0) for x in printable) + "".join(SINGLE.values())
    said = (printable + "".join(SINGLE) + blanks + INVISIBLE).replace("'", "''")
    return sql_hiragana(f"regexp_replace(translate({c}, '{said}', '{wide}{'　' * len(blanks)}'), '[\\s　・]', '', 'g')")


FACTS = """
latest AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY speech_id ORDER BY fetched_at DESC, row_id DESC) AS n FROM speech WHERE speech_id IS NOT NULL) WHERE n = 1),
facts AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY date, issue_id, speech_order, row_id) AS rowid FROM latest),
members AS (SELECT * FROM facts WHERE speaker_kind = '議員')"""

RUNS = f"""
runs AS (SELECT period, rowid, date, issue_id, unnest(regexp_extract_all(body, '{RUN_PATTERN}')) AS run FROM members),
windows AS (SELECT DISTINCT r.period, r.rowid, r.date, r.issue_id, substr({sql_fold('r.run')}, CAST(i AS INT), CAST(k AS INT)) AS term
    FROM runs r, (SELECT unnest([2, 3, 4]) AS k), LATERAL (SELECT unnest(range(1, length(r.run) - k + 2)) AS i))"""

FORMS = "forms AS (SELECT * FROM (VALUES " + ", ".join(f"({t['id']}, '{f}')" for t in TOPICS for f in [t["term"], *t["variants"]]) + ") v(topic_id, form))"

HITS = FORMS + """,
hits AS (
    SELECT f.topic_id, m.period, m.rowid, m.date, coalesce(m.speaker_group, '') AS kaiha, CAST(sum((length(m.body) - length(replace(m.body, f.form, ''))) / length(f.form)) AS BIGINT) AS n
    FROM members m JOIN forms f ON contains(m.body, f.form) GROUP BY ALL)"""


def with_facts(body: str, *more: str) -> str:
    return "WITH " + ", ".join([FACTS, *more]) + body
