"""Search over speeches. One definition of the hits serves the rows, their number and their months."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.periods import month_of, period_of_issue_id, period_of_speech_id
from ..functions.text import marked_snippet, run_bigrams, snippet
from ..operators.facts import number_rows
from ..operators.postings import find_rows
from ..schemas import MEMBER
from .query_text import Plan, canonical_query, match_topic, probe_keys, split_terms, unsearchable_terms, word_plan

LIMIT = 20


@dataclass(frozen=True)
class Options:
    """What to search: the periods, and filters that hold on every path."""

    periods: tuple[str, ...] | None = None
    meeting: str | None = None
    politician: int | None = None
    limit: int = LIMIT
    before: dict[str, int] = field(default_factory=dict)


def _both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def plan_predicate(plan: Plan) -> Column:
    """A plan as a condition on the text; an empty plan finds nothing.

    ``fts`` compares without case, so SDGs is found however it is typed. ``word`` finds its driver only inside a run of one script, as the
    two-character index does, and its filters as they are.
    """
    body = F.col("body")
    if plan.mode == "fts":
        return _both([F.contains(F.lower(body), F.lit(t.lower())) for t in plan.terms]) if plan.terms and all(len(t) >= 3 for t in plan.terms) else F.lit(False)
    if not plan.driver or unsearchable_terms([plan.driver]):
        return F.lit(False)
    # A literal test comes first: it spares cutting runs out of texts that can't hold the driver.
    loose = F.contains(F.translate(body, "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ", "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ"), F.lit(plan.driver))
    return _both([loose, F.array_contains(run_bigrams(body), plan.driver), *[F.instr(body, f) > 0 for f in plan.filters]])


def population(speech: DataFrame) -> DataFrame:
    """The indexed speeches."""
    return speech.where(F.col("speaker_kind") == MEMBER)


@dataclass(frozen=True)
class Index:
    """What a build stores for searches over the indexed speeches, all partitioned by period and sorted by term.

    ``pairs``: lists of two-character keys of runs, ``letters``: of any three characters in lower case (period, term, block, rowids); ``topics``
    (period, topic_id, rowid, n); ``frequencies`` (period, term, n_speeches) of the pairs; ``bounds`` (period, month, first row id).
    """

    pairs: DataFrame
    letters: DataFrame
    topics: DataFrame
    frequencies: DataFrame
    bounds: DataFrame


def letter_keys(term: str) -> list[str]:
    """Keys of three characters that a text with this term holds; none for characters beyond the basic plane, whose windows may differ."""
    text = term.lower()
    return sorted({text[i : i + 3] for i in range(len(text) - 2) if max(text[i : i + 3]) < "\U00010000"})


def candidates(index: Index, plan: Plan, periods: tuple[str, ...] | None) -> tuple[DataFrame, bool] | None:
    """((period, rowid), whether these are the hits themselves), by the stored lists; nothing where no key narrows the search."""
    if plan.mode == "topic":
        held = index.topics.where(F.col("topic_id") == plan.topic)
        if periods is not None:
            held = held.where(F.col("period").isin(*periods) if periods else F.lit(False))
        return held.select("period", "rowid"), True
    if plan.mode == "fts":
        keys = sorted({k for t in plan.terms for k in letter_keys(t)})
        return (find_rows(index.letters, keys, periods), all(len(t) == 3 and letter_keys(t) for t in plan.terms)) if keys else None
    if not plan.driver or unsearchable_terms([plan.driver]):
        return None
    rows = find_rows(index.pairs, [plan.driver], periods)
    keys = sorted({k for f in plan.filters for k in letter_keys(f)})
    if keys:
        rows = rows.join(find_rows(index.letters, keys, periods), ["period", "rowid"], "left_semi")
    return rows, not plan.filters


def _filtered(speech: DataFrame, meeting: DataFrame, options: Options) -> DataFrame:
    rows = population(speech)
    if options.periods is not None:
        rows = rows.where(F.col("period").isin(*options.periods) if options.periods else F.lit(False))
    if options.politician is not None:
        rows = rows.where(F.col("politician_id") == options.politician)
    if options.meeting is not None:
        rows = rows.join(meeting.where(F.col("name") == options.meeting).select("issue_id"), "issue_id", "left_semi")
    return rows


def hits(speech: DataFrame, meeting: DataFrame, options: Options, plan: Plan, topics: list[dict] = (), index: Index | None = None) -> DataFrame:
    """Every speech that a search finds; the meeting is only joined where a filter needs it.

    With an index only the speeches of its posting lists are met, and their texts tested only where the lists leave a doubt.
    """
    rows = _filtered(speech, meeting, options)
    found = candidates(index, plan, options.periods) if index else None
    if found:
        rows = rows.join(found[0], ["period", "rowid"], "left_semi")
        if found[1]:
            return rows
        if plan.mode == "word":
            return rows.where(_both([F.instr("body", f) > 0 for f in plan.filters]))
    if plan.mode == "topic":
        forms = [f for t in topics if t["id"] == plan.topic for f in [t["term"], *(t.get("variants") or [])]]
        return rows.where(reduce(lambda a, b: a | b, [F.contains(F.col("body"), F.lit(f)) for f in forms], F.lit(False)))
    return rows.where(plan_predicate(plan))


def _told_by_lists(options: Options, plan: Plan, index: Index | None) -> DataFrame | None:
    """(period, rowid) of the hits, where the lists alone tell them."""
    if index is None or options.politician is not None or options.meeting is not None:
        return None
    found = candidates(index, plan, options.periods)
    return found[0] if found and found[1] else None


def page_hits(speech: DataFrame, meeting: DataFrame, options: Options, plan: Plan, topics: list[dict] = (), index: Index | None = None) -> DataFrame:
    """The hits of one page. Where the lists tell the hits, its few row ids are looked up first, and of the speeches only these are read."""
    told = _told_by_lists(options, plan, index)
    if told is None:
        return page(hits(speech, meeting, options, plan, topics, index), options)
    rows: dict[str, list[int]] = {}
    for r in page(told, options).collect():
        rows.setdefault(r.period, []).append(r.rowid)
    of_page = reduce(lambda a, b: a | b, [(F.col("period") == p) & F.col("rowid").isin(*ids) for p, ids in rows.items()], F.lit(False))
    pruned = F.col("period").isin(*rows) & F.col("rowid").isin(*sorted({i for ids in rows.values() for i in ids}))
    return population(speech).where(pruned & of_page if rows else F.lit(False))


def count_hits(speech: DataFrame, meeting: DataFrame, options: Options, plan: Plan, topics: list[dict] = (), index: Index | None = None) -> DataFrame:
    """(n): from the stored frequency of a single key, else from the lists, and from the texts only where these leave a doubt."""
    told = _told_by_lists(options, plan, index)
    if told is None:
        return count(hits(speech, meeting, options, plan, topics, index))
    if plan.mode != "word":
        return count(told)
    stored = index.frequencies.where(F.col("term") == plan.driver)
    if options.periods is not None:
        stored = stored.where(F.col("period").isin(*options.periods) if options.periods else F.lit(False))
    return stored.agg(F.coalesce(F.sum("n_speeches"), F.lit(0)).alias("n"))


def month_hits(speech: DataFrame, meeting: DataFrame, options: Options, plan: Plan, topics: list[dict] = (), index: Index | None = None) -> DataFrame:
    """(month, n): where the lists tell the hits, a row id alone tells its month, by the first row of each month."""
    told = _told_by_lists(options, plan, index)
    if told is None:
        return months(hits(speech, meeting, options, plan, topics, index))
    until = F.coalesce(F.lead("first").over(Window.partitionBy("period").orderBy("first")), F.lit((1 << 62) - 1))
    # At most a few months a period: the calendar bounds what is broadcast.
    spans = index.bounds.withColumn("until", until)
    return told.join(F.broadcast(spans), "period").where("rowid >= first AND rowid < until").groupBy("month").agg(F.count("*").alias("n"))


def walk(found: DataFrame, limit: int) -> DataFrame:
    """(place, page, period, rowid): every hit with its place, newest first, and the page it stands on."""
    numbered = number_rows(found.select("period", "rowid"), [F.desc("period"), F.desc("rowid")], "_n")
    return numbered.select((F.col("_n") - 1).cast("int").alias("place"), F.floor((F.col("_n") - 1) / limit).cast("int").alias("page"), "period", "rowid")


def shown_term(plan: Plan, topics: list[dict] = ()) -> str:
    if plan.mode == "fts":
        return plan.terms[0] if plan.terms else ""
    return next((t["term"] for t in topics if t["id"] == plan.topic), "") if plan.mode == "topic" else plan.driver


def result_rows(found: DataFrame, meeting: DataFrame, plan: Plan, topics: list[dict] = ()) -> DataFrame:
    """Hits as result rows: speech and meeting columns, and a snippet round the first hit."""
    term = F.lit(shown_term(plan, topics))
    text = marked_snippet(F.col("body"), term) if plan.mode == "fts" else snippet(F.col("body"), term)
    wide = found.select("period", "rowid", "speech_id", "issue_id", "date", "speaker", "speaker_group", "politician_id", text.alias("snippet"))
    return wide.join(meeting.select("issue_id", F.col("name").alias("meeting"), "house", "session"), "issue_id")


def page(found: DataFrame, options: Options) -> DataFrame:
    """The newest ``limit`` hits below the cursors; a cursor of 0 ends its period, a period without one starts at its end."""
    if options.before:
        cursor = F.create_map(*[x for p, at in options.before.items() for x in (F.lit(p), F.lit(at).cast("long"))])
        found = found.where(F.coalesce(F.col("rowid") < F.try_element_at(cursor, F.col("period")), F.lit(True)))
    return found.orderBy(F.desc("period"), F.desc("rowid")).limit(options.limit)


def count(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("n"))


def count_by_period(found: DataFrame) -> DataFrame:
    return found.groupBy("period").agg(F.count("*").alias("n"))


def months(found: DataFrame) -> DataFrame:
    return found.groupBy(month_of(F.col("date")).alias("month")).agg(F.count("*").alias("n"))


def active_periods(first: dt.date | None, last: dt.date | None, periods: list[str]) -> list[str]:
    """Of the periods, newest first, those between the first and last speech of a person; all where these are unknown."""
    half = lambda day: 2 * day.year + (day.month > 6)
    place = lambda p: 2 * int(p[:4]) + (p[4:] == "H2")
    return [p for p in sorted(periods, reverse=True) if (first is None or place(p) >= half(first)) and (last is None or place(p) <= half(last))]


def of_person(speech: DataFrame, politician: int, options: Options) -> DataFrame:
    rows = speech.where(F.col("politician_id") == politician)
    return rows if options.periods is None else rows.where(F.col("period").isin(*options.periods) if options.periods else F.lit(False))


def timeline(speech: DataFrame, politician: int, options: Options) -> DataFrame:
    """A person's speeches, newest first, with the head of each text."""
    return page(of_person(speech, politician, options), options).select("period", "rowid", "speech_id", "date", F.substring("body", 1, 160).alias("head"))


def timeline_page(speech: DataFrame, politician: int, periods: list[str], options: Options) -> Page:
    """A page of a person's speeches with its cursors."""
    return page_of(of_person(speech, politician, replace(options, periods=tuple(periods))), periods, options)


def speech_detail(speech: DataFrame, speech_id: str) -> DataFrame:
    """A speech by its id; the date inside the id prunes to one period."""
    where = F.col("speech_id") == speech_id
    return speech.where(where & (F.col("period") == F.coalesce(period_of_speech_id(F.lit(speech_id)), F.col("period"))))


def context(speech: DataFrame, issue_id: str, order: int, span: int = 3) -> DataFrame:
    """The speeches round one in its meeting, marked as before, self and after; the date inside the issue id prunes to one period."""
    here = (F.col("issue_id") == issue_id) & (F.col("period") == F.coalesce(period_of_issue_id(F.lit(issue_id)), F.col("period")))
    near = speech.where(here & F.col("speech_order").between(max(0, order - span), order + span))
    side = F.when(F.col("speech_order") < order, "before").when(F.col("speech_order") > order, "after").otherwise("self")
    return near.select("speech_id", "speech_order", "speaker", F.substring("body", 1, 140).alias("head"), side.alias("side"))


def meeting_names(meeting: DataFrame) -> DataFrame:
    return meeting.select("name").distinct().orderBy(F.expr("name COLLATE ja"))


def resolve_plan(text: str, bigram_df: DataFrame, topics: list[dict] = ()) -> Plan:
    """The plan for typed text: a topic if it is one, else by the frequencies of its short terms."""
    topic = match_topic(text, list(topics))
    if topic is not None:
        return Plan("topic", topic=topic)
    terms = split_terms(text)
    keys = probe_keys(terms)
    counts = {r.term: r.n for r in bigram_df.where(F.col("term").isin(*keys)).groupBy("term").agg(F.sum("n_speeches").alias("n")).collect()} if keys else {}
    return word_plan(terms, counts)


@dataclass
class Page:
    """One page: its rows, the cursors for the next one, and whether all periods are exhausted."""

    rows: list
    before: dict[str, int]
    done: bool


def merge_cursors(periods: list[str], rows: list[tuple[str, int]], per_period: dict[str, int], limit: int, before: dict[str, int]) -> tuple[dict[str, int], bool]:
    """Cursors after a page: the last row shown of each period, unchanged where none was shown, 0 where nothing is left."""
    after = dict(before)
    for p in periods:
        shown = [r for q, r in rows if q == p]
        if len(shown) == per_period.get(p, 0) < limit:
            after[p] = 0
        elif shown:
            after[p] = min(shown)
    return after, all(after.get(p) == 0 for p in periods)


def page_of(found: DataFrame, periods: list[str], options: Options) -> Page:
    """A page with its cursors. Only ``limit`` rows come to the driver, and a number for each period."""
    rows = [(r.period, r.rowid) for r in page(found, options).select("period", "rowid").collect()]
    left = dict.fromkeys(periods, 0)
    below = found.where(F.col("period").isin(*[p for p in periods if options.before.get(p) != 0]))
    if any(options.before.values()):
        at = F.create_map(*[x for p, n in options.before.items() for x in (F.lit(p), F.lit(n).cast("long"))])
        below = below.where(F.coalesce(F.col("rowid") < F.try_element_at(at, F.col("period")), F.lit(True)))
    left |= {r.period: min(r.n, options.limit) for r in below.groupBy("period").agg(F.count("*").alias("n")).collect()}
    return Page(rows, *merge_cursors(periods, rows, left, options.limit, dict(options.before)))


def search_page(speech: DataFrame, meeting: DataFrame, periods: list[str], options: Options, plan: Plan, topics: list[dict] = (), index: Index | None = None) -> Page:
    """A page of a search with its cursors."""
    return page_of(hits(speech, meeting, replace(options, periods=tuple(periods)), plan, topics, index), periods, options)


def search_bundle(text: str, speech: DataFrame, meeting: DataFrame, bigram_df: DataFrame, options: Options, topics: list[dict] = (), index: Index | None = None) -> dict[str, object]:
    """All that a search shows: the query as understood, impossible terms, the plan, rows, count and months (lazily)."""
    shown, impossible = canonical_query(text), unsearchable_terms(split_terms(text))
    plan = Plan("word") if impossible else resolve_plan(text, bigram_df, topics)
    asked = (speech, meeting, options, plan, topics, index)
    return {"query": shown, "unsearchable": impossible, "plan": plan, "rows": result_rows(page_hits(*asked), meeting, plan, topics), "count": count_hits(*asked), "months": month_hits(*asked)}
