"""Posting tables: two-character windows of script runs, and topics with their variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import KANJI_RUN, KATAKANA_RUN, WIDE_RUN, full_width, occurrences, run_bigrams
from ..schemas import TOPIC


def topic_table(spark: SparkSession, topics: list[dict]) -> DataFrame:
    return spark.createDataFrame([(t["id"], t["term"], t.get("category"), t.get("variants") or []) for t in topics], TOPIC)


def topic_postings(speech: DataFrame, topics: list[dict], keep: list[str]) -> DataFrame:
    """(topic_id, keep, n): occurrences of a topic's term and variants in each text that holds any.

    The list of topics is part of the query, so each text is scanned once with one expression a topic; nothing is crossed and nothing
    shuffled. Nested variants count twice, as the forms are summed.
    """
    cells = []
    for t in topics:
        forms = [t["term"], *(t.get("variants") or [])]
        n = sum((occurrences(F.col("body"), F.lit(f)) for f in forms[1:]), occurrences(F.col("body"), F.lit(forms[0])))
        cells.append(F.struct(F.lit(t["id"]).alias("topic_id"), n.alias("n")))
    if not cells:
        return speech.where(F.lit(False)).select(F.lit(0).alias("topic_id"), *keep, F.lit(0).cast("long").alias("n"))
    hits = F.filter(F.array(*cells), lambda x: x["n"] > 0)
    return speech.select(*keep, F.explode(hits).alias("_h")).select("_h.topic_id", *keep, "_h.n")


def bigram_postings(speech: DataFrame, keep: list[str]) -> DataFrame:
    """(term, keep): the distinct two-character windows inside the runs of each text, one row a text and window."""
    return speech.select(*keep, F.explode(run_bigrams(F.col("body"))).alias("term"))


def document_frequency(postings: DataFrame, keys: list[str]) -> DataFrame:
    return postings.groupBy(*keys).agg(F.count("*").alias("n_speeches"))


def letter_postings(speech: DataFrame, keep: list[str]) -> DataFrame:
    """(term, keep): the distinct windows of three characters of each text in lower case, one row a text and window."""
    letters = speech.select(*keep, F.split(F.lower("body"), "").alias("_c"))
    pairs = letters.select(*keep, "_c", F.zip_with("_c", F.slice("_c", F.lit(2), F.greatest(F.size("_c"), F.lit(1))), lambda a, b: F.concat(a, b)).alias("_p"))
    threes = F.zip_with("_p", F.slice("_c", F.lit(3), F.greatest(F.size("_c"), F.lit(1))), lambda a, b: F.concat(a, b))
    return pairs.select(*keep, F.explode(F.array_distinct(F.filter(threes, lambda x: F.char_length(x) == 3))).alias("term"))


#: Row ids that one posting list spans: 2 to this power. It bounds a list, however common its term is.
BLOCK_BITS = 16


def posting_lists(postings: DataFrame) -> DataFrame:
    """(period, term, block, rowids): postings as sorted lists, one for each block of row ids."""
    block = F.shiftright("rowid", BLOCK_BITS).alias("block")
    return postings.groupBy("period", "term", block).agg(F.sort_array(F.collect_list("rowid")).alias("rowids"))


def find_rows(lists: DataFrame, keys: list[str], periods: tuple[str, ...] | None = None) -> DataFrame:
    """(period, rowid) of the rows that all keys lead to. Only the lists of these keys are read; they meet within their block."""
    wanted = lists.where(F.col("term").isin(*keys))
    if periods is not None:
        wanted = wanted.where(F.col("period").isin(*periods) if periods else F.lit(False))
    if len(set(keys)) == 1:
        return wanted.select("period", F.explode("rowids").alias("rowid"))
    n = len(set(keys))
    met = wanted.groupBy("period", "block").agg(F.collect_list("rowids").alias("_l")).where(F.size("_l") == n)
    common = F.reduce(F.slice("_l", 2, n), F.element_at("_l", 1), lambda a, b: F.array_intersect(a, b))
    return met.select("period", F.explode(common).alias("rowid"))


def topic_forms(listed: DataFrame) -> DataFrame:
    """(id, form): every distinct term and variant of each topic."""
    return listed.select("id", F.explode(F.array_distinct(F.concat(F.array("term"), F.coalesce("variants", F.array().cast("array<string>"))))).alias("form")).where("form <> ''")


def overlapping_forms(listed: DataFrame) -> DataFrame:
    """(inner_id, form, outer_id, longer): forms that lie inside a longer one, of the same topic (counted twice) or of another.

    All substrings of the longer forms are joined with the forms, so the list is never paired with itself.
    """
    forms = topic_forms(listed)
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.char_length("form")), lambda i: F.transform(F.sequence(F.lit(1), F.char_length("form") - i + 1), lambda n: F.substring("form", i, n))))
    parts = forms.select(F.col("id").alias("outer_id"), F.col("form").alias("longer"), F.explode(F.array_distinct(spans)).alias("form")).where("form <> longer")
    return forms.withColumnRenamed("id", "inner_id").join(parts, "form").select("inner_id", "form", "outer_id", "longer")


def topic_problems(listed: DataFrame, retired: DataFrame) -> DataFrame:
    """(id, problem) of a hand-written list: ids used twice or again, terms no path finds, and forms that stand in or lie inside another topic's."""
    searchable = F.char_length("_w") > 2
    for pattern in (KANJI_RUN, KATAKANA_RUN, WIDE_RUN):
        searchable = searchable | F.col("_w").rlike(f"^(?:{pattern})$")
    twice = listed.groupBy("id").count().where("count > 1").select("id", F.lit("id used twice").alias("problem"))
    again = listed.join(retired.select("id").distinct(), "id", "left_semi").select("id", F.lit("id was retired").alias("problem"))
    lost = listed.withColumn("_w", full_width(F.col("term"))).where(~searchable).select("id", F.lit("term can't be searched").alias("problem"))
    forms = topic_forms(listed)
    shared = forms.groupBy("form").agg(F.min("id").alias("_first"), F.sort_array(F.collect_set("id")).alias("_ids")).where("size(_ids) > 1").select(F.explode(F.slice("_ids", 2, 1 << 20)).alias("id"), F.format_string("%s also in %s", "form", "_first").alias("problem"))
    inside = overlapping_forms(listed).select(F.col("inner_id").alias("id"), F.when(F.col("inner_id") == F.col("outer_id"), F.format_string("%s lies inside %s", "form", "longer")).otherwise(F.format_string("%s lies inside %s of %s", "form", "longer", F.col("outer_id").cast("string"))).alias("problem"))
    return twice.unionByName(again).unionByName(lost).unionByName(shared).unionByName(inside).distinct()


def topic_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change): topics added, removed, or changed in term or variants between two lists; any of them asks for new postings."""
    state = F.struct("term", F.coalesce("variants", F.array().cast("array<string>")).alias("variants"))
    both = old.select("id", state.alias("_a")).join(new.select("id", state.alias("_b")), "id", "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return both.select("id", change.alias("change")).where("change IS NOT NULL")
