"""Frequency of every distinct term: heavy-light aggregation.

Terms that a sample shows to be frequent are sent to every task, which counts them exactly in arrays of its own and
emits one row each at its end. All other terms are combined per batch and shuffled. The union of both tables is exact
whatever the sample held, as the sample only decides which way a term takes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import RUN_PATTERN, WIDE_LOWER, WIDE_UPPER
from ..operators.facts import latest_rows
from .arrow import map_batches, spread

#: The sample that finds heavy terms holds about so many records, and at most so many terms are heavy.
SAMPLE_RECORDS = 20_000
HEAVY_TERMS = 4_096
#: A term is heavy if it occurs in this share of the sampled records.
HEAVY_SHARE = 0.001

_RUNS = re.compile(RUN_PATTERN)
_SMALL = re.compile(f"[{WIDE_LOWER[0]}-{WIDE_LOWER[-1]}]")
_CAPITALS = str.maketrans(WIDE_LOWER, WIDE_UPPER)


def terms_of(text: str | None) -> list[str]:
    """The longest runs of a text in order, full-width small letters as capitals; null and empty have none."""
    if not text:
        return []
    if _SMALL.search(text):
        text = text.translate(_CAPITALS)
    return _RUNS.findall(text)


def heavy_terms(texts: DataFrame, records: int) -> list[str]:
    share = min(1.0, SAMPLE_RECORDS / max(1, records))
    sample = texts.sample(fraction=share, seed=7) if share < 1 else texts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        df_: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df_.update(set(terms_of(text)))
        yield {"term": list(df_), "n": list(df_.values())}

    found = map_batches(sample, count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return [r.term for r in found.where(F.col("n") >= max(2, HEAVY_SHARE * min(records, SAMPLE_RECORDS))).orderBy(F.desc("n"), "term").limit(HEAVY_TERMS).collect()]


def count_terms(texts: DataFrame, heavy: list[str]) -> DataFrame:
    """(term, occurrences, records) over a one-column table of texts, one row a record."""
    place = {t: i for i, t in enumerate(heavy)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        heavy_n, heavy_df = [0] * len(heavy), [0] * len(heavy)
        for batch in batches:
            n: Counter = Counter()
            df_: Counter = Counter()
            for text in batch.column(0).to_pylist():
                found = terms_of(text)
                n.update(found)
                df_.update(set(found))
            out = {"term": [], "slot": [], "occurrences": [], "records": []}
            for term, k in n.items():
                slot = place.get(term)
                if slot is None:
                    out["term"].append(term)
                    out["slot"].append(None)
                    out["occurrences"].append(k)
                    out["records"].append(df_[term])
                else:
                    heavy_n[slot] += k
                    heavy_df[slot] += df_[term]
            yield out
        slots = [i for i, k in enumerate(heavy_n) if k]
        yield {"term": [None] * len(slots), "slot": slots, "occurrences": [heavy_n[i] for i in slots], "records": [heavy_df[i] for i in slots]}

    parts = map_batches(texts, count, "term string, slot int, occurrences long, records long")
    # Light terms group by themselves, heavy ones by their slot: both sums combine before the shuffle.
    counted = parts.groupBy("slot", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    words = F.array(*[F.lit(t) for t in heavy]) if heavy else F.array().cast("array<string>")
    return counted.select(F.when(F.col("slot").isNull(), F.col("term")).otherwise(words[F.col("slot")]).alias("term"), "occurrences", "records")


def term_frequencies(df: DataFrame, record: str, version: str, tie: str, text: str, rare: int = 2, common: float = 0.1) -> DataFrame:
    """(term, occurrences, records, mark) over the latest row of each record.

    mark is ``rare`` for terms in at most ``rare`` records, ``common`` for terms in more than that share of all records, else
    null. Rows without a record id do not count; null or empty texts are records without terms; of equally late rows the
    one with the larger ``tie`` counts. An empty table gives no rows.
    """
    texts, records = latest_rows(df, record, version, tie)
    texts = spread(texts.select(F.col(text).cast("string"), F.col(tie).alias("_t")), "_t").select(text)
    # Any rows will do for the sample, repeated ones too.
    counted = count_terms(texts, heavy_terms(df.select(F.col(text).cast("string")), records))
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * records, "common")
    return counted.withColumn("mark", mark)
