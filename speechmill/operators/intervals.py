"""Overlapping and gapped intervals as bitmaps of days.

A day is a bit. Sixty-four days make a word (the time shard), sixty-four words a bit one level up, and so on, so
an interval of any length becomes at most eight words. Words of one entity are united with ``bit_or``, which
combines before the shuffle; what is left of an entity is bounded by the calendar, however many rows it had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BITS = 64
LEVELS = 4
#: Day numbers are shifted by this, so that every date from 0001-01-01 on is positive.
EPOCH_SHIFT = 1 << 20
LAST_DAY = 2_932_896  # 9999-12-31


def day_number(date: Column) -> Column:
    return F.unix_date(date.cast("date")).cast("long") + F.lit(EPOCH_SHIFT)


def day_text(day: Column) -> Column:
    return F.date_format(F.date_from_unix_date((day - F.lit(EPOCH_SHIFT)).cast("int")), "yyyy-MM-dd")


def to_words(df: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """(keys, level, word, bits) of the inclusive day ranges first..last.

    A level takes the units that the level below leaves whole. Its first and last unit follow from the days alone, so no expression nests in another.
    """
    words, before = [], 0
    for level in range(LEVELS):
        a = f"{first}" if level == 0 else f"(shiftright({first} + {before}L, {6 * level}) + 1)"
        b = f"{last}" if level == 0 else f"(shiftright({last} - {before}L, {6 * level}) - 1)"
        before += 64**level if level else 0
        wa, wb = f"shiftright({a}, 6)", f"shiftright({b}, 6)"

        def word(where: str, at: str, lo: str, hi: str, level: int = level) -> str:
            mask = f"shiftleft(shiftrightunsigned(-1L, cast(63 - ({hi} - {lo}) as int)), cast({lo} as int))"
            return f"IF({where}, named_struct('level', {level}, 'word', {at}, 'bits', {mask}), NULL)"

        words.append(word(f"{a} <= {b} AND {wa} = {wb}", wa, f"({a} & 63L)", f"({b} & 63L)"))
        words.append(word(f"{a} <= {b} AND {wa} < {wb}", wa, f"({a} & 63L)", "63L"))
        words.append(word(f"{a} <= {b} AND {wa} < {wb}", wb, "0L", f"({b} & 63L)"))
    return df.select(*keys, F.explode(F.expr(f"filter(array({', '.join(words)}), x -> x IS NOT NULL)")).alias("_w")).select(*keys, "_w.level", "_w.word", "_w.bits")


def unite(words: DataFrame, keys: list[str]) -> DataFrame:
    return words.groupBy(*keys, "level", "word").agg(F.bit_or("bits").alias("bits"))


def set_runs(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first, last): the longest unbroken stretches of set bits over all levels."""
    position = "filter(sequence(0, 63), i -> (shiftrightunsigned({}, i) & 1L) = 1L)"
    unit = f"cast(pow({BITS}, level) as long)"
    runs = (
        words.withColumn("_on", F.expr(position.format("(bits & ~shiftleft(bits, 1))")))
        .withColumn("_off", F.expr(position.format("(bits & ~shiftrightunsigned(bits, 1))")))
        .select(*keys, F.explode(F.arrays_zip("_on", "_off")).alias("_r"), "level", "word")
        .select(*keys, F.expr(f"(word * {BITS} + _r._on) * {unit}").alias("first"), F.expr(f"(word * {BITS} + _r._off + 1) * {unit} - 1").alias("last"))
    )
    by = Window.partitionBy(*keys).orderBy("first", "last")
    before = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    return (
        runs.withColumn("_new", F.when(before.isNull() | (F.col("first") > before + 1), 1).otherwise(0))
        .withColumn("_run", F.sum("_new").over(by))
        .groupBy(*keys, "_run")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .drop("_run")
    )


def clear_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The stretches between the set runs of a key."""
    after = F.lead("first").over(Window.partitionBy(*keys).orderBy("first"))
    return runs.withColumn("_next", after).where("_next IS NOT NULL").select(*keys, (F.col("last") + 1).alias("first"), (F.col("_next") - 1).alias("last"))


def shared_runs(runs: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Stretches on whose every day at least ``least`` of the (disjoint per attribute) runs of a key hold."""
    edges = runs.select(*keys, F.explode(F.array(F.struct(F.col("first").alias("day"), F.lit(1).alias("step")), F.struct((F.col("last") + 1).alias("day"), F.lit(-1).alias("step")))).alias("_e"))
    edges = edges.groupBy(*keys, F.col("_e.day").alias("day")).agg(F.sum("_e.step").alias("step"))
    by = Window.partitionBy(*keys).orderBy("day")
    depth = edges.withColumn("deep", F.sum("step").over(by) >= least)
    change = depth.withColumn("_was", F.coalesce(F.lag("deep").over(by), F.lit(False))).where("deep <> _was")
    return change.withColumn("last", F.lead("day").over(by) - 1).where("deep").select(*keys, F.col("day").alias("first"), "last")


def interval_spans(df: DataFrame, entity: str, start: str, end: str, attribute: str) -> DataFrame:
    """Continuous periods, gaps and doubly held stretches of each entity.

    ``start`` and ``end`` are inclusive dates. Rows without entity or start, or ending before they start, do not count; a
    missing end means 9999-12-31. ``period``: a longest stretch of days covered by at least one row; ``gap``: the stretch
    between two periods; ``double``: a longest stretch on each day of which two different non-null attributes hold.
    Repeated rows change nothing, an empty table gives no rows, other columns are ignored.
    """
    rows = (
        df.select(F.col(entity).cast("long").alias("entity"), day_number(F.col(start)).alias("first"), F.coalesce(F.least(day_number(F.col(end)), F.lit(LAST_DAY + EPOCH_SHIFT)), F.lit(LAST_DAY + EPOCH_SHIFT)).alias("last"), F.col(attribute).cast("string").alias("attribute"))
        .where("entity IS NOT NULL AND first IS NOT NULL AND last >= first")
    )
    words = unite(to_words(rows, ["entity", "attribute"], "first", "last"), ["entity", "attribute"])
    periods = set_runs(unite(words, ["entity"]), ["entity"])
    held = set_runs(words.where("attribute IS NOT NULL"), ["entity", "attribute"])
    kinds = [("period", periods), ("gap", clear_runs(periods, ["entity"])), ("double", shared_runs(held, ["entity"]))]
    spans = None
    for kind, runs in kinds:
        part = runs.select("entity", F.lit(kind).alias("span_kind"), day_text(F.col("first")).alias("from_date"), day_text(F.col("last")).alias("to_date"))
        spans = part if spans is None else spans.unionByName(part)
    return spans
