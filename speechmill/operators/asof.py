"""Attributes as they were known at the time of an event.

Only at a few days does the answer for an entity change: when a row begins to hold, ends, or becomes known. Counting those
changes gives every event a version number; the wide attributes are then joined by entity and number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intervals import EPOCH_SHIFT, day_number

LEVELS = 22
NEVER = (1 << LEVELS) - 1


def blocks(df: DataFrame, keep: list[str], first: str, last: str) -> DataFrame:
    """The aligned blocks of 2^level days that make up first..last, at most two a level."""
    level = f"""
        transform(sequence(0, {LEVELS - 1}), k -> named_struct('level', k,
            'l', shiftright({first} + shiftleft(1L, k) - 1, k), 'r', shiftright({last} + 1, k)))"""
    pieces = f"""
        flatten(transform({level}, x -> filter(array(
            IF(x.l < x.r AND (x.l & 1L) = 1L, named_struct('level', x.level, 'block', x.l), NULL),
            IF(x.l < x.r AND (x.r & 1L) = 1L, named_struct('level', x.level, 'block', x.r - 1), NULL)), y -> y IS NOT NULL)))"""
    return df.select(*keep, F.explode(F.expr(pieces)).alias("_b")).select(*keep, "_b.level", "_b.block")


def version_join(events: DataFrame, event_id: str, event_entity: str, event_date: str, rows: DataFrame, row_id: str, row_entity: str, start: str, end: str, known: str, attributes: list[str] = ()) -> DataFrame:
    """(event_id, row_id, attributes): of the rows that held on the event's day and were known by then, the one with the
    latest start, then the latest known time, then the largest id.

    ``end`` is inclusive and open when null; ``known`` is a timestamp that counts by its day. Events without entity or date, or
    without such a row, give no result; rows without entity, start or known time never hold. Repeated event rows each give a row.

    No event is gathered by entity alone: a third of all events may belong to one. Events are first reduced to distinct (entity, day), whose number the
    calendar bounds, and the winner of a version is a maximum over aligned blocks of days, which combines before the shuffle.
    """
    rows = rows.select(
        F.col(row_entity).cast("long").alias("entity"),
        F.greatest(day_number(F.col(start)), day_number(F.to_date(F.col(known)))).alias("first"),
        F.coalesce(day_number(F.col(end)), F.lit(NEVER - 1)).alias("last"),
        F.struct(day_number(F.col(start)).alias("start"), F.col(known).alias("known"), F.col(row_id).alias("id")).alias("rank"),
        *[F.col(a).alias(f"_attr_{a}") for a in attributes],
        F.col(row_id).alias("_row"),
        F.col(start).isNotNull().alias("_started"),
        F.col(known).isNotNull().alias("_known"),
    ).where("entity IS NOT NULL AND _started AND _known AND first <= last")
    facts = events.select(F.col(event_id).alias("_event"), F.col(event_entity).cast("long").alias("entity"), day_number(F.col(event_date)).alias("day")).where("entity IS NOT NULL AND day IS NOT NULL")

    changes = rows.select("entity", F.explode(F.array("first", F.col("last") + 1)).alias("day")).distinct()
    days = facts.select("entity", "day").distinct()
    ticks = changes.withColumn("change", F.lit(1)).unionByName(days.withColumn("change", F.lit(0))).groupBy("entity", "day").agg(F.max("change").alias("change"), F.min("change").alias("_e"))
    version = F.sum("change").over(Window.partitionBy("entity").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    ticks = ticks.withColumn("version", version)

    winners = blocks(rows, ["entity", "rank"], "first", "last").groupBy("entity", "level", "block").agg(F.max("rank").alias("rank"))
    begins = ticks.where("change = 1").select("entity", "version", F.explode(F.expr(f"transform(sequence(0, {LEVELS - 1}), k -> named_struct('level', k, 'block', shiftright(day, k)))")).alias("_b")).select("entity", "version", "_b.level", "_b.block")
    versions = begins.join(winners, ["entity", "level", "block"]).groupBy("entity", "version").agg(F.max("rank").alias("rank")).select("entity", "version", F.col("rank.id").alias("_row"))
    if attributes:
        wide = rows.select("_row", *[f"_attr_{a}" for a in attributes]).dropDuplicates(["_row"])
        versions = versions.join(wide, "_row")

    # Versions meet the narrow days, of which an entity has no more than the calendar; the events themselves are joined once, by entity and day.
    held = ticks.where("_e = 0").select("entity", "day", "version").join(versions, ["entity", "version"]).drop("version")
    out = facts.join(held, ["entity", "day"])
    return out.select(F.col("_event").alias(event_id), F.col("_row").alias(f"{row_id}_held" if row_id == event_id else row_id), *[F.col(f"_attr_{a}").alias(a) for a in attributes])


assert NEVER > 2_932_896 + EPOCH_SHIFT
