"""Half-year periods, months and other calendar arithmetic."""

from __future__ import annotations

import re
from datetime import date as Date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def period_of(d: Column, rule: str = "half") -> Column:
    """2026-03-01 → 2026H1; with the rule ``year`` → 2026."""
    year = F.date_format(d, "yyyy")
    return year if rule == "year" else F.concat(year, F.when(F.month(d) <= 6, "H1").when(F.month(d) > 6, "H2"))


def month_of(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def period_year(period: Column) -> Column:
    return F.substring(period, 1, 4).try_cast("int")


def period_index(period: Column) -> Column:
    """Consecutive numbers for consecutive periods of one rule."""
    year = F.substring(period, 1, 4).try_cast("int")
    return F.when(F.length(period) == 4, year).otherwise(year * 2 + F.substring(period, 6, 1).try_cast("int") - 1)


def date_in_issue_id(issue_id: Column) -> Column:
    """An issue id ends in its date, yyyyMMdd; null if it doesn't."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(issue_id, "(\\d{8})$", 1), F.lit("")), F.lit("yyyyMMdd")).cast("date")


def period_of_issue_id(issue_id: Column) -> Column:
    return period_of(date_in_issue_id(issue_id))


def period_of_speech_id(speech_id: Column) -> Column:
    """A speech id is its issue id, an underscore and a number."""
    return period_of_issue_id(F.regexp_extract(speech_id, "^(.+)_\\d+$", 1))


def calendar(spark: SparkSession, first: Date, last: Date) -> DataFrame:
    """One row a month from first to last."""
    return spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(first), "month"), F.trunc(F.lit(last), "month"), F.expr("interval 1 month"))).alias("first_day")).select(month_of(F.col("first_day")).alias("month"), "first_day")


def months_in_period(period: Column, first: Column, last: Column) -> Column:
    """The months of a period, clipped to a coverage."""
    year = F.substring(period, 1, 4)
    half = F.substring(period, 6, 1)
    begin = F.to_date(F.concat(year, F.when(half == "2", "-07-01").otherwise("-01-01")))
    end = F.to_date(F.concat(year, F.when(half == "1", "-06-01").otherwise("-12-01")))
    a, b = F.greatest(begin, F.trunc(first, "month")), F.least(end, F.trunc(last, "month"))
    return F.when(a <= b, F.transform(F.sequence(a, b, F.expr("interval 1 month")), lambda m: month_of(m))).otherwise(F.array().cast("array<string>"))


def month_chunks(first: Date, last: Date) -> list[tuple[Date, Date]]:
    """A range of days cut at the ends of months."""
    out, at = [], first
    while at <= last:
        following = Date(at.year + at.month // 12, at.month % 12 + 1, 1)
        out.append((at, min(last, Date.fromordinal(following.toordinal() - 1))))
        at = following
    return out


def periods_in_years(periods: list[str], first: int, last: int) -> list[str]:
    """Period ids whose year lies between the bounds, in whichever order these are given; newest first."""
    low, high = sorted((first, last))
    return sorted((p for p in periods if re.fullmatch("\\d{4}(H[12])?", p) and low <= int(p[:4]) <= high), reverse=True)


def overdue(since: Column, today: Column, days: int) -> Column:
    return F.datediff(today, since) > days
