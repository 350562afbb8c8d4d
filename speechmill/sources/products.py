"""What is published from the tables: products as JSON lines, reports as Markdown, and the lists of a front page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .reports import table_lines

#: Entries of the lists on the front page: topics, words of the current year, trending terms.
FRONT = {"topics": 12, "current": 12, "trending": 14}


def as_json(rows: DataFrame, key: str) -> DataFrame:
    """(key, value): each row as one JSON object, keys in order of the columns."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))


def topic_product(listed: DataFrame, totals: DataFrame, cells: DataFrame, axis: list[str]) -> DataFrame:
    """A row a topic: its entry, number of speeches and the dense series of its months. totals: topic_id, n_speeches; cells: topic_id, month, n."""
    series = cells.groupBy("topic_id").agg(F.map_from_entries(F.collect_list(F.struct("month", "n"))).alias("_m"))
    months = F.array(*[F.lit(m) for m in axis]) if axis else F.array().cast("array<string>")
    full = listed.join(totals, listed.id == totals.topic_id, "left").drop("topic_id").join(series.withColumnRenamed("topic_id", "_t"), F.col("id") == F.col("_t"), "left")
    return full.select("id", "term", "category", "variants", F.coalesce("n_speeches", F.lit(0)).alias("n_speeches"), F.transform(months, lambda m: F.coalesce(F.try_element_at("_m", m), F.lit(0))).alias("months"))


def trend_product(windows: DataFrame) -> DataFrame:
    """A row a window of sitting days with its terms by rank."""
    terms = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term", "n"))), lambda x: F.struct(x["term"].alias("term"), x["n"].alias("n")))
    return windows.groupBy("window", F.date_format("from_date", "yyyy-MM-dd").alias("from"), F.date_format("until", "yyyy-MM-dd").alias("until"), "sitting_days", "n_speeches").agg(terms.alias("terms"))


def activity_product(activity: DataFrame, axis: list[str]) -> DataFrame:
    """A row a person with the months of their speeches, months without one left out. activity: politician_id, month, n."""
    place = F.create_map(*[x for i, m in enumerate(axis) for x in (F.lit(m), F.lit(i))]) if axis else F.lit(None).cast("map<string,int>")
    pairs = F.array_sort(F.collect_list(F.struct(F.try_element_at(place, F.col("month")).alias("at"), "n")))
    return activity.groupBy("politician_id").agg(F.sum("n").alias("n_speeches"), F.flatten(F.transform(pairs, lambda x: F.array(x["at"].cast("long"), x["n"]))).alias("series"))


def save_product(rows: DataFrame, path: str) -> None:
    """JSON lines, in the shared folder."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def front_page(topics: DataFrame, words: DataFrame, trending: DataFrame, sizes: dict[str, int] = FRONT) -> DataFrame:
    """(list, place, term, value): topics by speeches, words of the latest peak year by burst, and the newest window's terms by rank; ties by term.

    topics: term, n_speeches; words: term, burst, peak_year; trending: window, rank, term, n.
    """
    last = words.agg(F.max("peak_year")).first()[0]
    lists = [
        ("topics", topics.select("term", F.col("n_speeches").cast("double").alias("value"), F.lit(0).alias("_r"))),
        ("current", words.where(F.col("peak_year") == last).select("term", F.col("burst").cast("double").alias("value"), F.lit(0).alias("_r"))),
        ("trending", trending.where("window = 0").select("term", F.col("n").cast("double").alias("value"), F.col("rank").alias("_r"))),
    ]
    parts = []
    for name, rows in lists:
        order = ("_r", F.desc("value"), "term")
        # At most a dozen rows are numbered.
        top = rows.orderBy(*order).limit(sizes[name])
        parts.append(top.select(F.lit(name).alias("list"), F.row_number().over(Window.orderBy(*order)).alias("place"), "term", "value"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def report_lines(title: str, sections: list[tuple[str, str, DataFrame, list[Column]]]) -> DataFrame:
    """(section, place, line): a report whose sections are (heading, note, rows, order). The tables are rankings and to-do lists, small by nature."""
    parts = []
    for k, (heading, note, rows, order) in enumerate(sections):
        head, _ = table_lines(rows)
        lead = [x for x in ((f"# {title}" if k == 0 else None), f"## {heading}", note or None, *head.split("\n")) if x]
        numbered = rows.withColumn("_n", F.row_number().over(Window.orderBy(*order)) + (len(lead) - 1))
        body = numbered.select(F.lit(k).alias("section"), F.col("_n").alias("place"), *rows.columns)
        text = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in rows.columns]), F.lit(" |"))
        parts.append(body.select("section", "place", text.alias("line")))
        parts.append(rows.sparkSession.createDataFrame([(k, i, x) for i, x in enumerate(lead)], "section int, place int, line string"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def save_report(lines: DataFrame, path: str) -> None:
    """The lines in order as one text file in the shared folder."""
    lines.orderBy("section", "place").select("line").coalesce(1).write.mode("overwrite").text(path)


def candidate_report(lists: DataFrame, windows: DataFrame) -> DataFrame:
    """Candidate terms by list, and the terms that trend now."""
    return report_lines("Candidates for topics", [("Candidates", "", lists.select("list", "rank", "term"), [F.col("list"), F.col("rank")]), ("Trending", "By windows of sitting days, newest first.", windows.select("window", "rank", "term", "n"), [F.col("window"), F.col("rank")])])


def new_terms_report(fresh: DataFrame) -> DataFrame:
    return report_lines("Terms in no topic", [("New", "", fresh, [F.desc("lift"), F.col("term")])])


def frequent_report(words: DataFrame) -> DataFrame:
    return report_lines("Frequent words", [("Words", "", words.select("term", "n", "peak"), [F.desc("n"), F.col("term")])])


def people_report(people: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Persons by their speeches, and the affiliations whose party is unknown with the reason."""
    return report_lines("Persons", [("Persons", "", people.select("seq", "name", "name_kana", "wikidata_id", "n_speeches"), [F.col("seq")]), ("Unknown parties", "", unresolved, [F.desc("speeches"), F.col("kaiha"), F.col("why")])])


def todo_report(matched: DataFrame) -> DataFrame:
    """Units that nobody or several people fit, the largest first."""
    rows = matched.where("n_candidates <> 1").select("speaker", "speaker_yomi", "speaker_group", "n_candidates", "n_speeches")
    return report_lines("To do", [("Unmatched units", "", rows, [F.desc("n_speeches"), F.col("speaker"), F.col("speaker_yomi"), F.col("speaker_group")])])


def matching_report(report: DataFrame) -> DataFrame:
    """How units were matched, by route and signal."""
    return report_lines("Matching of names", [("Routes", "", report.select("route", "narrowed_by", "status", "units", "speeches", "percent"), [F.col("route"), F.col("narrowed_by"), F.col("status")])])
