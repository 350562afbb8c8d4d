"""Name search, typed sorting, runs of ids and small profile reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import HIRAGANA, KATAKANA, fold

_FOLD = str.maketrans(KATAKANA, HIRAGANA)


def match_names(people: DataFrame, query: str, limit: int = 60, with_group: bool = True) -> DataFrame:
    """People whose name, reading or group holds the query; exact names first, then beginnings, then parts; then by n, then name in Japanese order.

    ``people`` has id, name, kana, kaiha, n. Blanks and kana script don't matter; a blank query finds nobody.
    """
    wanted = "".join(query.split()).replace("　", "").translate(_FOLD)
    if not wanted:
        return people.withColumn("rank", F.lit(0)).where(F.lit(False))
    name, kana, kaiha = (fold(F.col(c)) for c in ("name", "kana", "kaiha"))
    q = F.lit(wanted)
    rank = F.when(name == q, 0).when(F.startswith(name, q), 1).when(F.contains(name, q), 2).when(F.startswith(kana, q), 3).when(F.contains(kana, q), 4)
    if with_group:
        rank = rank.when(F.contains(kaiha, q), 5)
    return people.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", F.desc("n"), F.expr("name COLLATE ja"), "id").limit(limit)


def filter_names(people: DataFrame, query: str) -> DataFrame:
    """Everyone whose name, reading and group together hold the query."""
    wanted = "".join(query.split()).replace("　", "").translate(_FOLD)
    key = fold(F.concat_ws("|", "name", "kana", "kaiha"))
    return people.where(F.contains(key, F.lit(wanted)))


def typed_order(column: str, kind: str = "text", descending: bool | None = None) -> list[Column]:
    """Sort keys of a column as text, number or date. Blanks come last either way; text ascends and others descend by default."""
    c = F.col(column)
    down = (kind != "text") if descending is None else descending
    blank = c.isNull() | (F.trim(c.cast("string")) == "")
    key = {"text": F.expr(f"`{column}` COLLATE ja"), "num": F.expr(f"try_cast(`{column}` AS double)"), "date": c.cast("string")}[kind]
    return [F.when(blank, 1).otherwise(0).asc(), key.desc() if down else key.asc()]


def people_order(column: str, kind: str = "text", descending: bool | None = None) -> list[Column]:
    """The order of a list of people by a column: equal ones by reading, those without a reading after, then by id."""
    return [*typed_order(column, kind, descending), *typed_order("kana", "text"), F.col("id").asc()]


def id_ranges(df: DataFrame, id_column: str, keys: list[str] = ()) -> DataFrame:
    """(keys, ids): consecutive ids as ranges, ``1-3,5``. Islands are found by id minus rank and then joined to text."""
    rows = df.select(*keys, F.col(id_column).cast("long").alias("_id")).where("_id IS NOT NULL").distinct()
    by = Window.partitionBy(*keys).orderBy("_id")
    islands = rows.withColumn("_g", F.col("_id") - F.row_number().over(by)).groupBy(*keys, "_g").agg(F.min("_id").alias("_a"), F.max("_id").alias("_b"))
    text = F.when(F.col("_a") == F.col("_b"), F.col("_a").cast("string")).otherwise(F.concat_ws("-", F.col("_a").cast("string"), F.col("_b").cast("string")))
    pairs = F.array_sort(F.collect_list(F.struct("_a", text.alias("t"))))
    return islands.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda x: x["t"]), ",").alias("ids"))


def parse_ranges(text: Column) -> Column:
    """The ids of a range text; a bad text has none."""
    parts = F.transform(F.split(text, ","), lambda p: F.sequence(F.substring_index(p, "-", 1).cast("long"), F.substring_index(p, "-", -1).cast("long")))
    return F.when(text.rlike("^\\d+(-\\d+)?(,\\d+(-\\d+)?)*$"), F.flatten(parts)).otherwise(F.array().cast("array<long>"))


def missing_shares(df: DataFrame) -> DataFrame:
    """(field, missing_percent): nulls and blank texts of every column, in one pass."""
    cells = [F.struct(F.lit(c).alias("field"), F.round(F.avg(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), 100.0).otherwise(0.0)), 1).alias("missing_percent")) for c in df.columns if not df.schema[c].dataType.typeName() == "array"]
    return df.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.field", "_c.missing_percent")


def top_values(df: DataFrame, column: str, most: int = 20) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(most)


def odd_blanks(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, n): values with blanks at an end, twice in a row, or of an unusual kind."""
    cells = [F.struct(F.lit(c).alias("field"), F.count_if(F.col(c).rlike("^[\\s　]|[\\s　]$|[ 　]{2,}|[\\t\\u00a0\\u2002\\u2003\\u202f\\u205f]")).alias("n")) for c in columns]
    return df.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.field", "_c.n")


def yearly_volume(speech: DataFrame, per_request: int = 100, seconds: float = 3.0) -> DataFrame:
    """(year, records, requests, hours): what fetching a year again would take."""
    by = speech.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("records"))
    requests = F.ceil(F.col("records") / per_request)
    return by.withColumn("requests", requests).withColumn("hours", F.round(requests * seconds / 3600, 2))


def next_ids(current: DataFrame, held: DataFrame) -> DataFrame:
    """(next_id, retired): the id after all current and retired ones, and the ids held somewhere that are no longer listed."""
    ids = current.select("id", F.lit(True).alias("now")).unionByName(held.select("id", F.lit(False).alias("now"))).groupBy("id").agg(F.bool_or("now").alias("now"))
    return ids.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"), F.array_sort(F.collect_list(F.when(~F.col("now"), F.col("id")))).alias("retired"))


def span_text(first: Column, last: Column) -> Column:
    """``2025-01-20〜06-22``; the year is given once if both days share it."""
    tail = F.when(F.year(first) == F.year(last), F.date_format(last, "MM-dd")).otherwise(F.date_format(last, "yyyy-MM-dd"))
    return F.concat(F.date_format(first, "yyyy-MM-dd"), F.lit("〜"), tail)


def weekday_text(d: Column) -> Column:
    """``2025-01-20（月）``"""
    days = F.array(*[F.lit(x) for x in "月火水木金土日"])
    return F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("（"), F.element_at(days, F.weekday(d) + 1), F.lit("）"))
