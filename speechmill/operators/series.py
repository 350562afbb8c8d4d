"""Time series: topics by month and group, their denominators, rates and lifts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.periods import month_of
from ..functions.text import rate
from .postings import topic_postings

ALL = "*"


def topic_cells(speech: DataFrame, topics: list[dict]) -> DataFrame:
    """(topic_id, month, kaiha, n_speeches, n_occurrences); kaiha ``*`` holds all speeches, also those without a group."""
    rows = speech.select(month_of(F.col("date")).alias("month"), F.coalesce("speaker_group", F.lit("")).alias("kaiha"), "body")
    found = topic_postings(rows, topics, ["month", "kaiha"])
    cells = found.groupingSets([["topic_id", "month"], ["topic_id", "month", "kaiha"]], "topic_id", "month", "kaiha").agg(F.count("*").alias("n_speeches"), F.sum("n").alias("n_occurrences"), F.grouping("kaiha").alias("_all"))
    return cells.select("topic_id", "month", F.when(F.col("_all") == 1, ALL).otherwise(F.col("kaiha")).alias("kaiha"), "n_speeches", "n_occurrences")


def speech_totals(speech: DataFrame) -> DataFrame:
    """(month, kaiha, total) with ``*`` for all."""
    rows = speech.select(month_of(F.col("date")).alias("month"), F.coalesce("speaker_group", F.lit("")).alias("kaiha"))
    totals = rows.groupingSets([["month"], ["month", "kaiha"]], "month", "kaiha").agg(F.count("*").alias("total"), F.grouping("kaiha").alias("_all"))
    return totals.select("month", F.when(F.col("_all") == 1, ALL).otherwise(F.col("kaiha")).alias("kaiha"), "total")


def kept_groups(totals: DataFrame, least: int) -> DataFrame:
    """Groups with that many speeches over the whole span, largest first."""
    return totals.where((F.col("kaiha") != ALL) & (F.col("kaiha") != "")).groupBy("kaiha").agg(F.sum("total").alias("volume")).where(F.col("volume") >= least)


def topic_totals(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("kaiha") == ALL).groupBy("topic_id").agg(F.sum("n_speeches").alias("n_speeches"), F.sum("n_occurrences").alias("n_occurrences"))


def meeting_totals(speech: DataFrame, meeting: DataFrame) -> DataFrame:
    """(name, month, n): the denominators of searches in one meeting."""
    rows = speech.select("issue_id", month_of(F.col("date")).alias("month")).groupBy("issue_id", "month").agg(F.count("*").alias("n"))
    return rows.join(meeting.select("issue_id", "name"), "issue_id").groupBy("name", "month").agg(F.sum("n").alias("n"))


def dense(cells: DataFrame, keys: list[str], at: str, value: str, axis: list[str]) -> DataFrame:
    """One array a key with a value for every place of the axis, 0 where there is no cell. The axis is short: months of the corpus."""
    sums = [F.coalesce(F.sum(F.when(F.col(at) == a, F.col(value))), F.lit(0)) for a in axis]
    return cells.groupBy(*keys).agg(F.array(*sums).alias("series"))


def densify(sparse, length):
    """An array column of (idx, n) pairs as a dense array of a length."""
    pairs = F.map_from_entries(sparse)
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.coalesce(F.try_element_at(pairs, i.cast("int")), F.lit(0).cast("long")))


def axis_months(speech: DataFrame) -> list[str]:
    return sorted(r.month for r in speech.select(month_of(F.col("date")).alias("month")).distinct().collect())


def rates(cells: DataFrame, totals: DataFrame, keep_without_total: bool = False) -> DataFrame:
    """Hits per thousand speeches of the same month and group. Months without a total drop out, or stay with rate 0 if they have hits."""
    both = cells.join(totals, ["month", "kaiha"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    kept = (F.col("total") > 0) | (F.lit(keep_without_total) & (F.col("n_speeches") > 0))
    return both.where(kept).withColumn("rate", rate(F.col("n_speeches"), F.col("total")))


def group_rates(cells: DataFrame, totals: DataFrame, least: int = 2000) -> DataFrame:
    """(topic_id, kaiha, hits, total, rate) over the whole span, for groups of that volume."""
    hits = cells.where(F.col("kaiha") != ALL).groupBy("topic_id", "kaiha").agg(F.sum("n_speeches").alias("hits"))
    return hits.join(kept_groups(totals, least), "kaiha").select("topic_id", "kaiha", "hits", F.col("volume").alias("total"), rate(F.col("hits"), F.col("volume")).alias("rate"))


def stacks(cells: DataFrame) -> DataFrame:
    """(topic_id, month, height, largest) of stacked groups."""
    return cells.where(F.col("kaiha") != ALL).groupBy("topic_id", "month").agg(F.sum("n_speeches").alias("height"), F.max("n_speeches").alias("largest"))


def peaks(rated: DataFrame) -> DataFrame:
    """The month of the highest rate, the first on ties."""
    best = Window.partitionBy("topic_id", "kaiha").orderBy(F.desc("rate"), "month")
    return rated.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def low_support(rated: DataFrame, least: int = 500) -> DataFrame:
    return rated.withColumn("low_support", F.col("total") < least)


def bar_shares(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each value as a percentage of its key's largest."""
    return rows.withColumn("share", F.round(F.col(value) * 100 / F.max(value).over(Window.partitionBy(*keys)), 1))


def trend_mode(monthly: DataFrame, totals: DataFrame) -> DataFrame:
    """Months of hits with their denominators; ``rate`` only if every month with hits has one."""
    both = monthly.join(totals, "month", "left")
    # One row a month: the calendar bounds the window over all of them.
    usable = F.bool_and(F.coalesce(F.col("total") > 0, F.lit(False)) | (F.col("n") == 0)).over(Window.partitionBy())
    mode = F.when(F.col("_usable"), "rate").otherwise("count")
    return both.withColumn("_usable", usable).select("month", "n", "total", mode.alias("mode"), F.when(F.col("_usable") & (F.col("total") > 0), rate(F.col("n"), F.col("total"))).alias("rate"))


def session_lift(hits: DataFrame, sessions: DataFrame, words: DataFrame, total: int, least: int = 30) -> DataFrame:
    """(session, term, hits, lift): a word's share of a session's speeches against its share of all; ranked by lift, hits, term."""
    both = hits.where(F.col("hits") >= least).join(words.select("term", "n"), "term").join(sessions.select("session", "n_speeches"), "session").where("n > 0 AND n_speeches > 0")
    lifted = both.withColumn("lift", (F.col("hits") / F.col("n_speeches")) / (F.col("n") / F.lit(float(total))))
    return lifted.select("session", "term", "hits", "lift").withColumn("rank", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("lift"), F.desc("hits"), "term")))


def sessions(speech: DataFrame, meeting: DataFrame, least: int = 3000) -> DataFrame:
    """(session, first, last, n_speeches, n_meetings, before, after) of sessions with enough speeches, and their neighbours."""
    held = meeting.groupBy("session").agg(F.count("*").alias("n_meetings"))
    rows = speech.groupBy("issue_id").agg(F.count("*").alias("n"), F.min("date").alias("a"), F.max("date").alias("b")).join(meeting.select("issue_id", "session"), "issue_id")
    out = rows.groupBy("session").agg(F.min("a").alias("first"), F.max("b").alias("last"), F.sum("n").alias("n_speeches")).where(F.col("n_speeches") >= least).join(held, "session")
    by = Window.orderBy("session")
    return out.withColumn("before", F.lag("session").over(by)).withColumn("after", F.lead("session").over(by))
