"""Raw records as newline-delimited JSON, in a file a month; reference data as JSON; a paged API as a Spark data source."""

from __future__ import annotations

import importlib
import json
import re
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.periods import period_of
from ..operators.entity import fold_bindings
from ..operators.facts import latest_rows, meeting_rows, number_in_periods, speech_rows
from ..schemas import KB_MEMBER, KB_TERM, RAW

# What the API serves a page, the bytes of a query, the pause and the tries.
PAGE = 100
QUERY_BYTES = 2_000
PAUSE = 3.0
TRIES = 4


def read_raw(spark: SparkSession, folder: str, year: int | None = None) -> DataFrame:
    """Raw records of ``YYYY-MM.ndjson`` files, with ``file`` and ``seq`` for their order. An empty choice is an error.

    Blank lines are skipped. The name of a file only chooses files; a record's own date decides its period.
    """
    pattern = f"{year or ''}*-*.ndjson" if year is None else f"{year}-*.ndjson"
    lines = spark.read.option("pathGlobFilter", pattern).text(folder).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("seq"))
    if lines.limit(1).isEmpty():
        raise FileNotFoundError(f"no records in {folder} for {year or 'any year'}")
    parsed = lines.where(F.trim("value") != "").select(F.from_json("value", RAW).alias("r"), "file", "seq")
    return parsed.select("r.*", F.regexp_extract("file", "([^/]+)$", 1).alias("file"), "seq")


def available_periods(spark: SparkSession, folder: str, rule: str = "half") -> list[str]:
    """Periods that the file names speak of, newest first."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*-*.ndjson").load(folder).select(F.regexp_extract("path", "(\\d{4}-\\d{2})\\.ndjson$", 1).alias("m")).where("m <> ''")
    found = names.select(period_of(F.to_date(F.concat("m", F.lit("-01"))), rule).alias("p")).distinct()
    return sorted((r.p for r in found.collect()), reverse=True)


def outside_period(raw: DataFrame) -> DataFrame:
    """(file, n): records whose date is not in the month their file is named after."""
    return raw.where(F.substring("date", 1, 7) != F.regexp_extract("file", "(\\d{4}-\\d{2})", 1)).groupBy("file").agg(F.count("*").alias("n"))


def build_facts(spark: SparkSession, raw: DataFrame, folder: str, periods: list[str] | None = None) -> DataFrame:
    """Write speech and meeting tables; only the given periods (or all) are replaced. Returns what each period holds.

    The last record of a speech id wins, the first of a meeting. Speeches lie partitioned by period and sorted by row id.
    """
    rows = speech_rows(raw).withColumnRenamed("seq", "row_id").drop("file")
    if periods is not None:
        rows = rows.where(F.col("period").isin(*periods))
    latest, _ = latest_rows(rows, "speech_id", "row_id", "row_id")
    numbered = number_in_periods(latest)
    (numbered.sortWithinPartitions("period", "rowid").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(f"{folder}/speech"))
    meeting_rows(raw, "seq").write.mode("overwrite").parquet(f"{folder}/meeting")
    return spark.read.parquet(f"{folder}/speech").groupBy("period").agg(F.countDistinct("issue_id").alias("meetings"), F.count("*").alias("speeches"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def read_reference(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document as rows of a schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_knowledge_base(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(members, terms of office) from a snapshot of the knowledge base: ``persons*.json`` and ``terms*.json``, a JSON object a line.

    A person comes in several rows, one for each combination of their optional values: the first non-empty name and reading count, houses and
    parties are listed as first seen. Rows without an id drop out; of equal terms one stays.
    """
    value = "id string, name string, kana string, house string, party string"
    rows = spark.read.schema(value).option("pathGlobFilter", "persons*.json").json(folder).where("id IS NOT NULL").withColumn("_o", F.monotonically_increasing_id())
    folded = fold_bindings(rows, "id", "_o", ["name", "kana"], ["house", "party"])
    members = folded.select(F.col("id").alias("wikidata_id"), "name", "kana", F.col("house").alias("houses"), F.col("party").alias("parties"))
    terms = spark.read.schema("id string, house string, start string, end string, district string").option("pathGlobFilter", "terms*.json").json(folder).where("id IS NOT NULL").distinct()
    day = lambda c: F.to_date(F.substring(c, 1, 10)).alias(c)
    return members.select(*KB_MEMBER.names), terms.select(F.col("id").alias("wikidata_id"), "house", day("start"), day("end"), "district").select(*KB_TERM.names)


def kb_problems(members: DataFrame, terms: DataFrame) -> DataFrame:
    """(wikidata_id, problem): what a snapshot should be asked about again: no name, no reading, several readings of one id, terms that end before they start."""
    checks = F.array(F.when(F.coalesce(F.length("name"), F.lit(0)) == 0, "no name"), F.when(F.coalesce(F.length("kana"), F.lit(0)) == 0, "no reading"), F.when(F.size("parties") == 0, "no party"))
    first = members.select("wikidata_id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("problem"))
    return first.unionByName(terms.where(F.col("end") < F.col("start")).select("wikidata_id", F.lit("term ends before it starts").alias("problem"))).distinct()


def pipe_table(text: str) -> list[dict[str, str]]:
    """The rows of the first pipe table of a Markdown text, by its header."""
    rows = [[c.strip() for c in line.strip().strip("|").split("|")] for line in text.splitlines() if line.strip().startswith("|")]
    if len(rows) < 2:
        return []
    head, *body = rows
    return [dict(zip(head, r)) for r in body if not all(re.fullmatch(":?-+:?", c) for c in r)]


def fetch_page(get: Callable[[dict], dict], query: dict, tries: int = TRIES, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One page, tried again with doubling pauses. An error inside an answer counts as a failure; an over-long query is refused."""
    if not any(query.get(k) for k in query if k not in ("startRecord", "maximumRecords")):
        raise ValueError("a query needs a condition")
    if len(json.dumps(query, ensure_ascii=False).encode()) > QUERY_BYTES:
        raise ValueError("the query is too long")
    for k in range(tries):
        try:
            answer = get(query)
            if "message" in answer:
                raise OSError(answer["message"])
            return answer
        except OSError:
            if k == tries - 1:
                raise
            sleep(pause * 2**k)
    raise AssertionError


def pages(get: Callable[[dict], dict], query: dict, start: int = 1, limit: int | None = None, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Records of all pages from ``start``, following each answer's next position, with a pause between pages."""
    at, given = start, 0
    while at:
        answer = fetch_page(get, query | {"startRecord": at, "maximumRecords": PAGE}, pause=pause, sleep=sleep)
        for record in answer.get("speechRecord", []):
            if limit is not None and given >= limit:
                return
            given += 1
            yield record
        at = answer.get("nextRecordPosition")
        if at:
            sleep(pause)


def count_records(get: Callable[[dict], dict], query: dict) -> int:
    return int(fetch_page(get, query | {"startRecord": 1, "maximumRecords": 1}).get("numberOfRecords", 0))


class PagedRecords(DataSource):
    """``spark.read.format("paged_records")``: one partition, as the API asks for paced requests.

    Options: ``startRecord``, and where pages come from: ``getter`` (``module:function``, importable by the executors, from a query to an answer, such
    as an HTTP client of the caller's), or ``folder`` with page files ``<start>.json`` that every executor can read. ``pause`` in seconds between pages.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self):
        return RAW

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        pause = float(self.options.get("pause", PAUSE if "getter" in self.options else 0))
        if "getter" in self.options:
            module, _, name = self.options["getter"].partition(":")
            get = getattr(importlib.import_module(module), name)
        else:
            folder = Path(self.options["folder"])

            def get(query: dict) -> dict:
                return json.loads((folder / f"{query['startRecord']}.json").read_text(encoding="utf-8"))

        names = RAW.names
        for record in pages(get, {"from": self.options.get("from", "*")}, int(self.options.get("startrecord", 1)), pause=pause):
            yield tuple(Row(**{n: record.get(n) for n in names}))


def resume_month(get: Callable[[dict], dict], query: dict, path: Path, sleep: Callable[[float], None] = time.sleep) -> str:
    """Fetch one month into a file, going on where a part left off: skip, empty, recovered, mismatch or done.

    The lines of the ``.part`` file are its position. The file takes its name only when its lines are as many as the API counts.
    """
    part = path.with_suffix(path.suffix + ".part")
    expected = count_records(get, query)
    if path.exists() and sum(1 for _ in path.open(encoding="utf-8")) == expected:
        return "skip"
    if expected == 0:
        return "empty"
    held = sum(1 for _ in part.open(encoding="utf-8")) if part.exists() else 0
    if held < expected:
        with part.open("a", encoding="utf-8") as out:
            for record in pages(get, query, held + 1, sleep=sleep):
                out.write(json.dumps(record, ensure_ascii=False) + "\n")
    if sum(1 for _ in part.open(encoding="utf-8")) != expected:
        return "mismatch"
    part.replace(path)
    return "recovered" if held else "done"


def resume_months(get: Callable[[dict], dict], queries: dict[str, dict], folder: Path, sleep: Callable[[float], None] = time.sleep) -> list[tuple[str, str]]:
    """(month, state) of several months in order. A month that fails is noted as ``failed: reason`` and the others go on; its part stays for the next run."""
    out = []
    for month, query in sorted(queries.items()):
        try:
            state = resume_month(get, query, folder / f"{month}.ndjson", sleep)
        except (OSError, ValueError) as error:
            state = f"failed: {error}"
        out.append((month, state))
    return out


def ingest_status(folder: Path, months: list[str]) -> list[tuple[str, str, int]]:
    """(month, state, lines) of what has been fetched."""
    out = []
    for m in months:
        whole, part = folder / f"{m}.ndjson", folder / f"{m}.ndjson.part"
        at = whole if whole.exists() else part if part.exists() else None
        out.append((m, "done" if at == whole else "part" if at else "open", sum(1 for _ in at.open(encoding="utf-8")) if at else 0))
    return out
