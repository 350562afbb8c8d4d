"""Building all stored tables of a corpus, period by period, with a manifest that tells what each period holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fingerprint
from ..operators.facts import content_version, latest_rows, number_in_periods
from ..operators.postings import bigram_postings, document_frequency, letter_postings, posting_lists, topic_postings
from ..operators.quality import month_bounds
from ..plans.search import Index, population
from ..session import materialize

#: Tables of a store that lie partitioned by period, by the columns they are sorted by.
TABLES = {"speech": ["rowid"], "pairs": ["term"], "letters": ["term"], "topics": ["topic_id", "rowid"], "frequencies": ["term"], "bounds": ["first"]}
#: No period may take more than so many megabytes.
LARGEST_MB = 480.0
_KEEP = ["period", "rowid"]


@dataclass(frozen=True)
class Store:
    """A corpus as it was built."""

    speech: DataFrame
    meeting: DataFrame
    index: Index
    manifest: DataFrame


def topics_print(topics: list[dict]) -> str:
    """Text that changes with the id, term or variants of any topic."""
    return "\n".join(sorted(f"{t['id']}|{t['term']}|{','.join(sorted(t.get('variants') or []))}" for t in topics))


def period_entries(speech: DataFrame, index: Index, topics: list[dict]) -> DataFrame:
    """(id, meetings, speeches, indexed, hits, words, first_date, last_date, version, topics_fp) of each period; dates as text."""
    members = F.count_if(F.col("speaker_kind") == "議員")
    found = speech.groupBy("period").agg(F.count_distinct("issue_id").alias("meetings"), F.count("*").alias("speeches"), members.alias("indexed"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    hits = index.topics.groupBy("period").agg(F.count("*").alias("hits"))
    words = index.frequencies.groupBy("period").agg(F.count("*").alias("words"))
    version = content_version(speech, "period", ["speech_id", "rowid", "date", "speaker", "politician_id", "body"])
    rows = found.join(hits, "period", "left").join(words, "period", "left").join(version, "period")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return rows.select(F.col("period").alias("id"), "meetings", "speeches", "indexed", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("words", F.lit(0)).alias("words"), day("first_date"), day("last_date"), "version", fingerprint(F.array(F.lit(topics_print(topics)))).alias("topics_fp"))


def totals(manifest: DataFrame) -> DataFrame:
    """(periods, speeches, indexed, hits, first_date, last_date) of a whole corpus."""
    return manifest.agg(F.count("*").alias("periods"), F.sum("speeches").alias("speeches"), F.sum("indexed").alias("indexed"), F.sum("hits").alias("hits"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))


def _megabytes(spark: SparkSession, folder: str, period: str) -> float:
    size = 0
    for name in TABLES:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/period={period}")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        size += fs.getContentSummary(path).getLength() if fs.exists(path) else 0
    return size / 1e6


def build_store(spark: SparkSession, speech: DataFrame, meeting: DataFrame, folder: str, topics: list[dict], periods: list[str] | None = None, largest_mb: float = LARGEST_MB) -> Store:
    """Write every table of the chosen periods (or of all), then the manifest; periods not chosen stay as they are.

    speech: rows with speech_id, fetched_at, row_id and period, of which the latest of an id counts. A period above ``largest_mb`` is an error,
    raised after all are written and before the manifest names them, so that readers go on with the old one. An empty choice is one too.
    """
    rows = speech if periods is None else speech.where(F.col("period").isin(*periods))
    latest, n = latest_rows(rows, "speech_id", "fetched_at", "row_id")
    if not n:
        raise ValueError(f"no speeches in {periods or 'any period'}")

    def write(name: str, df: DataFrame) -> DataFrame:
        by = TABLES[name]
        writer = df.repartitionByRange("period", *by).sortWithinPartitions("period", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period")
        (writer.option("parquet.bloom.filter.enabled#term", "true").option("parquet.block.size", 16 << 20) if "term" in by else writer).parquet(f"{folder}/{name}")
        table = spark.read.parquet(f"{folder}/{name}")
        return table if periods is None else table.where(F.col("period").isin(*periods))

    facts = write("speech", number_in_periods(latest))
    members = population(facts)
    pairs = bigram_postings(members, _KEEP)
    index = Index(write("pairs", posting_lists(pairs)), write("letters", posting_lists(letter_postings(members, _KEEP))), write("topics", topic_postings(members, topics, _KEEP)), write("frequencies", document_frequency(pairs, ["period", "term"])), write("bounds", month_bounds(facts)))
    meeting.write.mode("overwrite").parquet(f"{folder}/meeting")
    entries = materialize(period_entries(facts, index, topics))
    # A row a period: the calendar bounds them.
    sizes = [(r.id, _megabytes(spark, folder, r.id)) for r in entries.select("id").collect()]
    too_large = [f"{p}: {size:.0f} MB" for p, size in sizes if size > largest_mb]
    if too_large:
        raise ValueError(f"periods above {largest_mb:.0f} MB: {', '.join(too_large)}")
    entries = entries.join(F.broadcast(spark.createDataFrame(sizes, "id string, size_mb double")), "id")
    if periods is not None:
        old = read_manifest(spark, folder)
        if old is not None:
            entries = old.join(entries.select("id"), "id", "left_anti").unionByName(entries)
    materialize(entries).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return open_store(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/_SUCCESS")
    return spark.read.parquet(f"{folder}/manifest") if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path) else None


def open_store(spark: SparkSession, folder: str) -> Store:
    """The tables as they are now; file listings are read again, so a store rewritten since an earlier opening is seen whole."""
    manifest = read_manifest(spark, folder)
    if manifest is None:
        raise FileNotFoundError(f"no manifest in {folder}")
    for name in (*TABLES, "meeting"):
        spark.catalog.refreshByPath(f"{folder}/{name}")
    read = {name: spark.read.parquet(f"{folder}/{name}") for name in (*TABLES, "meeting")}
    return Store(read["speech"], read["meeting"], Index(*(read[x] for x in ("pairs", "letters", "topics", "frequencies", "bounds"))), manifest)


def stale_periods(seen: DataFrame, manifest: DataFrame) -> DataFrame:
    """(id, state): periods that a reader who holds ``seen`` has to read again: new, changed or gone."""
    both = seen.select("id", F.col("version").alias("_old")).join(manifest.select("id", "version"), "id", "full")
    state = F.when(F.col("_old").isNull(), "new").when(F.col("version").isNull(), "gone").when(F.col("_old") != F.col("version"), "changed")
    return both.select("id", state.alias("state")).where("state IS NOT NULL")
