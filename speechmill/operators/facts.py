"""From raw records to fact tables: classification, latest versions, order, and a catalog of periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.periods import period_of
from ..schemas import MEETING_COLUMNS, MEMBER, NON_SPEECH, OUTSIDE_ROLES, SPEECH_COLUMNS
from ..session import materialize, small_enough


def classify(speaker: Column, role: Column, yomi: Column) -> tuple[Column, Column]:
    """(is_speech, speaker_kind): headings, then outside roles, then members by their reading, then officials."""
    heading = F.coalesce(speaker.isin(*NON_SPEECH), F.lit(False))
    outside = F.coalesce(role.isin(*OUTSIDE_ROLES), F.lit(False))
    kind = F.when(heading, "非発言").when(outside, role).when(F.coalesce(F.length(yomi), F.lit(0)) > 0, MEMBER).otherwise("政府参考人等")
    return F.when(heading, 0).otherwise(1), kind


def speech_rows(raw: DataFrame, rule: str = "half") -> DataFrame:
    """Raw records as speech rows; the record's own date decides its period, not the file it came in."""
    is_speech, kind = classify(F.col("speaker"), F.col("speakerRole"), F.col("speakerYomi"))
    columns = [F.to_date(c).alias(n) if n == "date" else F.col(c).alias(n) for c, n in SPEECH_COLUMNS.items()]
    more = [c for c in raw.columns if c not in SPEECH_COLUMNS and c not in MEETING_COLUMNS]
    return raw.select(*columns, is_speech.alias("is_speech"), kind.alias("speaker_kind"), period_of(F.to_date("date"), rule).alias("period"), *more)


def meeting_rows(raw: DataFrame, order: str) -> DataFrame:
    """One row a meeting, from the first record of its issue id."""
    columns = [F.to_date(c).alias(n) if n == "date" else F.col(c).alias(n) for c, n in MEETING_COLUMNS.items()]
    first = F.min(F.struct(F.col(order).alias("_o"), *columns)).alias("_m")
    return raw.where("issueID IS NOT NULL").groupBy(F.col("issueID").alias("_i")).agg(first).select("_m.*").drop("_o")


def latest_rows(df: DataFrame, record: str, version: str, tie: str) -> tuple[DataFrame, int]:
    """The latest row of each record with all columns, and the number of records; the last version wins, then the larger ``tie``.

    Wide columns never move: only the records that have several rows are looked up, broadcast while they are few, and joined by
    a shuffle beyond. Rows without a record id drop out. Of rows that even share version and tie one is kept.
    """
    named = df.where(F.col(record).isNotNull())
    narrow = named.select(F.col(record).alias("_r"), F.struct(F.col(version).alias("v"), F.col(tie).alias("t")).alias("_v"))
    several = materialize(narrow.groupBy("_r").agg(F.max("_v").alias("_best"), F.count("*").alias("_n")).where("_n > 1"))
    found = several.agg(F.count("*"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).first()
    best = several.select("_r", "_best")
    if small_enough(found[0], 128):
        best = F.broadcast(best)
    this = F.struct(named[version].alias("v"), named[tie].alias("t"))
    rows = named.join(best, named[record] == best["_r"], "left").where(F.col("_r").isNull() | F.col("_best").eqNullSafe(this))
    repeated = narrow.join(best, "_r").where(F.col("_best").eqNullSafe(F.col("_v"))).groupBy("_r").count().where("count > 1")
    if found[0] and not repeated.isEmpty():
        rows = rows.where("_r IS NULL").unionByName(rows.where("_r IS NOT NULL").dropDuplicates(["_r"]))
    return rows.select(*df.columns), named.count() - found[1]


def number_rows(df: DataFrame, order: list[str], number: str, partitions: int = 0) -> DataFrame:
    """Consecutive numbers from 1 in a global order, without one task sorting everything.

    Rows are range-partitioned and sorted; each partition's first number is the count of those before it. The numbered rows are
    checkpointed, as range bounds come from a sample and must not be drawn twice. ``order`` must be a total order.
    """
    ranged = (df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)).sortWithinPartitions(*order)
    marked = materialize(ranged.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = marked.groupBy("_p").agg(F.count("*").alias("_c"))
    # One row a partition: the cluster's size bounds it, not the data's.
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    return marked.join(F.broadcast(offsets), "_p").withColumn(number, F.col("_before") + F.col("_m") + 1).drop("_p", "_m", "_before")


def number_in_periods(df: DataFrame) -> DataFrame:
    """row ids within each period in order of date, meeting and speech order: the order that newest-first refers to."""
    numbered = number_rows(df, ["period", "date", "issue_id", "speech_order", "row_id"], "_n")
    starts = numbered.groupBy("period").agg(F.min("_n").alias("_first"))
    return numbered.join(F.broadcast(starts), "period").withColumn("rowid", F.col("_n") - F.col("_first") + 1).drop("_n", "_first")


def period_stats(speech: DataFrame, meeting: DataFrame) -> DataFrame:
    """A row a period: meetings, speeches, indexed speeches, first and last date."""
    return speech.groupBy("period").agg(F.countDistinct("issue_id").alias("meetings"), F.count("*").alias("speeches"), F.count_if(F.col("speaker_kind") == MEMBER).alias("indexed"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def kind_shares(speech: DataFrame) -> DataFrame:
    """Speeches by kind with their percentage of all."""
    by = speech.groupBy("speaker_kind").agg(F.count("*").alias("n"))
    return by.withColumn("percent", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy()), 1))


def merge_catalog(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of the new listing, and those of the old one whose period it doesn't hold; marks changed versions."""
    columns = [c for c in new.columns if c != "id"]
    both = old.select("id", *[F.col(c).alias(f"_old_{c}") for c in columns]).join(new.withColumn("_is_new", F.lit(True)), "id", "full")
    picked = [F.when(F.col("_is_new"), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c) for c in columns]
    changed = F.coalesce(F.col("_is_new") & F.col("_old_version").isNotNull() & (F.col("_old_version") != F.col("version")), F.lit(False)).alias("changed")
    return both.select("id", *picked, changed).orderBy("id")


def content_version(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, version): sixteen hex digits that change with any row of the key, whatever their order."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    sums = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)") for i in range(4)]
    return df.groupBy(key).agg(F.count("*").alias("_n"), *[s.alias(f"_s{i}") for i, s in enumerate(sums)]).select(key, F.substring(F.sha2(F.concat_ws("/", F.col("_n").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(4)]), 256), 1, 16).alias("version"))
