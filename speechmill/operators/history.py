"""History of changing attributes from periodic snapshots, by differencing each snapshot against the one before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import same_look


def snapshot_events(df: DataFrame, key: str, snapshot: str, attributes: dict[str, Column], loaded: str, tie: str) -> DataFrame:
    """(entity, day, kind, state): kind is inserted, changed or deleted against the snapshot before.

    Of several rows of an entity and snapshot the one loaded last counts (then the largest ``tie``). Snapshots are numbered in date
    order over the whole table; a null-safe full outer join of each number with the next classifies the entities.
    """
    state = F.struct(*[c.alias(name) for name, c in attributes.items()])
    rows = df.select(F.col(key).cast("long").alias("entity"), F.col(snapshot).cast("date").alias("day"), F.struct(F.col(loaded).alias("loaded"), F.col(tie).alias("tie"), state.alias("state")).alias("pick")).where("entity IS NOT NULL AND day IS NOT NULL")
    rows = rows.groupBy("entity", "day").agg(F.max("pick").alias("pick")).select("entity", "day", F.col("pick.state").alias("state"))
    # One row a snapshot date: the calendar bounds it, and so the one task that numbers them.
    dates = rows.select("day").distinct().withColumn("seq", F.row_number().over(Window.orderBy("day")))
    rows = rows.join(F.broadcast(dates), "day")
    now = rows.select(F.col("entity").alias("now_entity"), F.col("seq").alias("now_seq"), F.col("state").alias("new"), "day")
    before = rows.select(F.col("entity").alias("old_entity"), (F.col("seq") + 1).alias("old_seq"), F.col("state").alias("old"))
    both = now.join(before, F.expr("now_entity <=> old_entity AND now_seq <=> old_seq"), "full")
    kind = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select(F.coalesce("now_entity", "old_entity").alias("entity"), F.coalesce("now_seq", "old_seq").alias("seq"), "day", kind.alias("kind"), F.col("new").alias("state")).where("kind IS NOT NULL")


def versions(df: DataFrame, key: str, snapshot: str, attributes: dict[str, Column], loaded: str, tie: str) -> DataFrame:
    """(entity, attributes, valid_from, valid_to): every version, valid until the day before the next or 9999-12-31.

    An entity missing from a snapshot is no change: a re-inserted state equal to the last known one opens no version. Nulls
    equal only nulls; rows without entity or snapshot date do not count. An entity has at most one event a snapshot, so no window grows with the rows.
    """
    by = Window.partitionBy("entity").orderBy("seq")
    events = snapshot_events(df, key, snapshot, attributes, loaded, tie).where("kind <> 'deleted'")
    # A state is a struct and never null, so a null here means that there is none before.
    kept = events.withColumn("_was", F.lag("state").over(by)).where(F.col("_was").isNull() | ~F.col("_was").eqNullSafe(F.col("state")))
    until = F.coalesce(F.date_format(F.date_sub(F.lead("day").over(by), 1), "yyyy-MM-dd"), F.lit("9999-12-31"))
    return kept.select("entity", *[F.col(f"state.{a}").alias(a) for a in attributes], F.date_format("day", "yyyy-MM-dd").alias("valid_from"), until.alias("valid_to"))


def affiliation_history(df: DataFrame) -> DataFrame:
    """Versions of kaiha and party of each politician; kaiha that look the same are equal."""
    return versions(df, "politician_id", "snapshot_date", {"kaiha": same_look(F.col("kaiha")), "party": F.col("party")}, "loaded_at", "snap_id")
