"""What each person spoke in: roll-ups by meeting and month, with the smaller ones folded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.periods import month_of

OTHER = "その他"


def activity(speech: DataFrame, meeting: DataFrame) -> DataFrame:
    """(politician_id, name, month, n)."""
    counts = speech.where("politician_id IS NOT NULL").groupBy("politician_id", "issue_id", month_of(F.col("date")).alias("month")).agg(F.count("*").alias("n"))
    return counts.join(meeting.select("issue_id", "name"), "issue_id").groupBy("politician_id", "name", "month").agg(F.sum("n").alias("n"))


def fold_small(cells: DataFrame, entity: str, label: str, value: str, most: int = 7, other: str = OTHER) -> DataFrame:
    """The entity's largest labels by total, ties by label; all others become one."""
    totals = cells.groupBy(entity, label).agg(F.sum(value).alias("_t"))
    ranked = totals.withColumn("_k", F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("_t"), label))).select(entity, label, "_k")
    named = cells.join(ranked, [entity, label]).withColumn(label, F.when(F.col("_k") <= most, F.col(label)).otherwise(other))
    return named.groupBy(entity, label, *[c for c in cells.columns if c not in (entity, label, value)]).agg(F.sum(value).alias(value))


def sparse_series(cells: DataFrame, keys: list[str], at: str, value: str, axis: list[str]) -> DataFrame:
    """One array of (idx, n) pairs a key, in order of the axis."""
    place = F.create_map(*[x for i, a in enumerate(axis) for x in (F.lit(a), F.lit(i))])
    return cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.element_at(place, F.col(at)).alias("idx"), F.col(value).alias("n")))).alias("series"))


def drop_empty(cells: DataFrame, keys: list[str], value: str, year: str | None = None, at: str = "month") -> DataFrame:
    """A year's cells without the series that are zero in it."""
    rows = cells.where(F.substring(at, 1, 4) == year) if year else cells
    return rows.withColumn("_s", F.sum(value).over(Window.partitionBy(*keys))).where("_s > 0").drop("_s")


def corpus_totals(speech: DataFrame, stats: DataFrame) -> DataFrame:
    """People, their speeches, the largest period and the end of coverage."""
    people = speech.where("politician_id IS NOT NULL").agg(F.count_distinct("politician_id").alias("people"), F.count("*").alias("speeches"))
    largest = stats.agg(F.max_by("period", F.struct("speeches", "period")).alias("p"), F.max("last_date").alias("d")).first()
    return people.withColumns({"largest_period": F.lit(largest.p).cast("string"), "until": F.lit(largest.d).cast("date")})
