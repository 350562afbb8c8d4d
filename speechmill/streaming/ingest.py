"""Incremental ingest: new files of records replace the speeches they correct, and only the periods they touch are rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.window import Window

from ..functions.periods import period_of
from ..functions.text import CANDIDATE_PATTERN, runs
from ..operators.facts import latest_rows, speech_rows
from ..schemas import MEMBER, RAW
from ..session import materialize, small_enough


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Raw records of files as they arrive. No watermark: a late record is a correction and must never be dropped."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.ndjson").json(folder)


def upsert(spark: SparkSession, batch: DataFrame, batch_id: int, table: str) -> list[str]:
    """Merge a batch into the table. Later batches win by speech id, inside a batch the larger fetch position.

    Every period that a new record belongs to, or that an older version of it lay in, is written again; others are not read. Replaying a
    batch gives the same table, as the batch id decides between versions. Returns the periods written.
    """
    fresh = speech_rows(batch).withColumns({"batch_id": F.lit(batch_id).cast("long"), "row_id": F.monotonically_increasing_id()})
    fresh = materialize(fresh)
    held = spark.read.parquet(table) if _exists(spark, table) else None
    if held is None:
        rows = fresh
    else:
        held = held.select(*fresh.columns)
        moved = held.select("speech_id", "period").join(F.broadcast(fresh.select("speech_id").distinct()) if small_enough(fresh.count(), 64) else fresh.select("speech_id").distinct(), "speech_id", "left_semi").select("period")
        touched = [r.period for r in fresh.select("period").union(moved).distinct().collect()]
        rows = held.where(F.col("period").isin(*touched) & (F.col("batch_id") != batch_id)).unionByName(fresh)
    ranked = rows.withColumn("_v", F.struct("batch_id", "row_id"))
    latest, _ = latest_rows(ranked, "speech_id", "_v", "row_id")
    # The checkpoint keeps the rows while the partitions they were read from are replaced.
    out = materialize(latest.drop("_v"))
    if held is not None:
        emptied = set(touched) - {r.period for r in out.select("period").distinct().collect()}
        for period in emptied:
            _drop(spark, f"{table}/period={period}")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(table)
    return touched if held is not None else [r.period for r in out.select("period").distinct().collect()]


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def refresh_daily(spark: SparkSession, table: str, daily: str, periods: list[str]) -> None:
    """Count the candidate terms of each day of these periods again: (date, term, n, period), and how many speeches the day has as the term ''.

    A correction changes what earlier batches counted, so a period's counts are replaced, never added to; windows of sitting days are cut from them.
    """
    rows = spark.read.parquet(table).where(F.col("period").isin(*periods) & (F.col("speaker_kind") == MEMBER))
    terms = F.concat(F.array(F.lit("")), runs(F.col("body"), CANDIDATE_PATTERN))
    counted = rows.select("date", "period", F.explode(terms).alias("term")).groupBy("date", "term", "period").agg(F.count("*").alias("n"))
    for period in set(periods) - {r.period for r in rows.select("period").distinct().collect()}:
        _drop(spark, f"{daily}/period={period}")
    counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(daily)


def sitting_windows(daily: DataFrame, days: int = 5, windows: int = 8) -> DataFrame:
    """(window, from_date, until, sitting_days, n_speeches, term, n) of the newest windows of ``days`` sitting days; the oldest may be shorter."""
    # One row a sitting day: the calendar bounds what is numbered in one task.
    sat = daily.where("term = ''").groupBy("date").agg(F.sum("n").alias("_k")).withColumn("window", F.floor((F.row_number().over(Window.orderBy(F.desc("date"))) - 1) / days).cast("int")).where(F.col("window") < windows)
    spans = sat.groupBy("window").agg(F.min("date").alias("from_date"), F.max("date").alias("until"), F.count("*").alias("sitting_days"), F.sum("_k").alias("n_speeches"))
    inside = daily.where("term <> ''").join(F.broadcast(sat.select("date", "window")), "date").groupBy("window", "term").agg(F.sum("n").alias("n"))
    return inside.join(F.broadcast(spans), "window").select("window", "from_date", "until", "sitting_days", "n_speeches", "term", "n")


def start_ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, daily: str | None = None) -> StreamingQuery:
    """Ingest all files that are there and stop; the checkpoint remembers which were done. With ``daily`` its counts follow each batch."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        touched = upsert(spark, batch, batch_id, table)
        if daily and touched:
            refresh_daily(spark, table, daily, touched)

    return read_stream(spark, folder).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()


def touched_periods(today: str, rule: str = "half") -> list[str]:
    """Periods that a run reads again: that of this month, and in a period's first month the one before."""
    year, month = int(today[:4]), int(today[5:7])
    now = f"{year}H{1 if month <= 6 else 2}" if rule == "half" else str(year)
    if month == 1:
        return [now, f"{year - 1}H2" if rule == "half" else str(year - 1)]
    return [now, f"{year}H1"] if month == 7 and rule == "half" else [now]


def read_again(today: str) -> list[str]:
    """Months that a run fetches again: this and the one before."""
    year, month = int(today[:4]), int(today[5:7])
    return [f"{year - (month == 1):04d}-{(month - 2) % 12 + 1:02d}", f"{year:04d}-{month:02d}"]
