"""Checks that the tables keep their promises. Each returns the offending rows, so an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.periods import month_of, period_index, period_of
from .facts import number_rows


def _neighbours(rows: DataFrame, number: str, value: str) -> DataFrame:
    """(period, number, value, before): each row with its predecessor's value, by an equi-join of consecutive numbers; no task sorts a period."""
    before = rows.select(F.col("period").alias("_p"), (F.col(number) + 1).alias("_n"), F.col(value).alias("before"))
    return rows.join(before, (F.col("period") == F.col("_p")) & (F.col(number) == F.col("_n")), "left").select("period", number, value, "before")


def inversions(facts: DataFrame) -> DataFrame:
    """(period, n): rows dated before the row that precedes them."""
    return _neighbours(facts.select("period", "rowid", "date"), "rowid", "date").where("before > date").groupBy("period").agg(F.count("*").alias("n"))


def arrival_inversions(speech: DataFrame) -> DataFrame:
    """(period, n): the same in order of arrival, counted for every period."""
    numbered = number_rows(speech.select("period", "row_id", "date"), ["period", "row_id"], "n")
    return _neighbours(numbered.select("period", "n", "date"), "n", "date").groupBy("period").agg(F.count_if(F.col("before") > F.col("date")).alias("n"))


def month_bounds(facts: DataFrame) -> DataFrame:
    """(period, month, first): the first row of each month."""
    return facts.groupBy("period", month_of(F.col("date")).alias("month")).agg(F.min("rowid").alias("first"))


def bound_mismatches(facts: DataFrame) -> DataFrame:
    """Months whose first row by date is not where the month changes in row order."""
    rows = _neighbours(facts.select("period", "rowid", month_of(F.col("date")).alias("month")), "rowid", "month")
    sought = rows.where("before IS NULL OR before <> month").select("period", "month", F.col("rowid").alias("first"))
    return sought.exceptAll(month_bounds(facts)).unionByName(month_bounds(facts).exceptAll(sought))


def frequency_mismatches(stored: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """Keys whose stored frequency is not the number of their postings."""
    counted = postings.groupBy(key).agg(F.count("*").alias("_n"))
    return stored.join(counted, key, "full").where(~F.col("n_speeches").eqNullSafe(F.col("_n"))).select(key, "n_speeches", F.col("_n").alias("postings"))


def false_hits(postings: DataFrame, facts: DataFrame) -> DataFrame:
    """Postings (term, period, rowid) whose text doesn't hold the term, width and case of letters aside."""
    texts = facts.select("period", "rowid", "body")
    folded = F.translate("body", "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ", "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ")
    return postings.join(texts, ["period", "rowid"]).where(~F.contains(folded, F.col("term"))).select("term", "period", "rowid")


def false_topic_hits(postings: DataFrame, facts: DataFrame, topics: list[dict]) -> DataFrame:
    """Topic postings (period, topic_id, rowid) whose text holds no form of the topic; a topic that is not listed has none."""
    forms = F.create_map(*[x for t in topics for x in (F.lit(t["id"]), F.array(*[F.lit(f) for f in [t["term"], *(t.get("variants") or [])]]))]) if topics else F.lit(None).cast("map<int,array<string>>")
    rows = postings.select("period", "topic_id", "rowid").join(facts.select("period", "rowid", "body"), ["period", "rowid"]).withColumn("_f", F.try_element_at(forms, F.col("topic_id")))
    return rows.where(~F.coalesce(F.exists("_f", lambda f: F.contains(F.col("body"), f)), F.lit(False))).select("topic_id", "period", "rowid")


def probed_false_hits(speech: DataFrame, found: DataFrame, holds, least: int = 1000) -> DataFrame:
    """Full-text hits whose text doesn't hold the terms (``holds``, a condition on body); none below ``least`` speeches, where probes say nothing."""
    return found.where(~holds) if large_enough(speech, least) else found.where(F.lit(False))


def catalog_problems(catalog: DataFrame, largest_mb: float = 480) -> DataFrame:
    """(id, problem): gaps and doubles of period ids, missing versions, oversized parts. catalog: id, version, size_mb."""
    by = Window.orderBy("id")
    rows = catalog.withColumn("_step", period_index(F.col("id")) - F.lag(period_index(F.col("id"))).over(by))
    checks = F.array(F.when(~F.col("id").rlike("^\\d{4}(H[12])?$"), "bad id"), F.when(F.col("_step") > 1, "gap before"), F.when(F.col("_step") == 0, "double"), F.when(F.coalesce("version", F.lit("")) == "", "no version"), F.when(F.col("size_mb") > largest_mb, "too large"))
    return rows.select("id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("problem"))


def coverage_problems(stats: DataFrame) -> DataFrame:
    """Periods whose first or last date lies outside."""
    return stats.where((period_of(F.col("first_date")) != F.col("period")) | (period_of(F.col("last_date")) != F.col("period")))


def topic_differences(held: DataFrame, listed: DataFrame) -> DataFrame:
    """(id, problem): topics that a part holds differently from the list, holds no longer, or lacks. Both: id, term, variants."""
    both = held.select("id", F.col("term").alias("_t"), F.col("variants").alias("_v")).join(listed.select("id", "term", "variants"), "id", "full")
    problem = F.when(F.col("term").isNull(), "stale").when(F.col("_t").isNull(), "missing").when(F.col("_t") != F.col("term"), "other term").when(~F.array_sort("_v").eqNullSafe(F.array_sort("variants")), "other variants")
    return both.select("id", problem.alias("problem")).where("problem IS NOT NULL")


def indexed_topics(listed: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, indexed): a topic is indexed only if every part holds it under the listed fingerprint. parts: period, ids, fp; listed: id, fp."""
    n = parts.select("period").distinct().count()
    held = parts.select("period", "fp", F.explode("ids").alias("id"))
    good = held.join(listed, ["id", "fp"]).groupBy("id").agg(F.count_distinct("period").alias("_k"))
    return listed.join(good, "id", "left").select("id", (F.coalesce("_k", F.lit(0)) == n).alias("indexed") if n else F.lit(False).alias("indexed"))


def large_enough(facts: DataFrame, least: int = 1000) -> bool:
    """Whether sample probes make sense; checks of structure always run."""
    return facts.limit(least).count() >= least
