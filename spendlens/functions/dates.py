"""Dates as column expressions: mixed formats, calendar columns, spans and spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
EPOCH_MILLIS = 10_000_000_000


def iso_date(text: Column) -> Column:
    """The date of the first 19 characters in one of four formats; null if in none."""
    t = F.substring(F.trim(text), 1, 19)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in FORMATS]).cast("date")


def mixed_date(text: Column) -> Column:
    """As iso_date, else whole seconds or milliseconds since 1970 (those above 10 thousand million)."""
    n = F.trim(text).try_cast("bigint")
    millis = F.when(n > EPOCH_MILLIS, n).otherwise(n * 1000)
    return F.coalesce(iso_date(text), F.timestamp_millis(millis).cast("date"))


def with_calendar(df: DataFrame, date: str = "issue_date") -> DataFrame:
    """``df`` with year, month, day, weekday (0: Monday) and mmdd of a date column."""
    d = F.col(date)
    return df.withColumns({"year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d), "weekday": F.weekday(d), "mmdd": F.date_format(d, "MM-dd")})


def delay_days(start: Column, end: Column) -> Column:
    """Days from one timestamp to another, with their fraction."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 86_400_000_000


def days_apart(left: Column, right: Column) -> Column:
    """Days between two dates, without sign."""
    return F.abs(F.datediff(left, right))


def within_days(left: Column, right: Column, days: int) -> Column:
    """Whether two dates are so near; a date that is not known is."""
    return F.coalesce(days_apart(left, right) <= days, F.lit(True))


def month_spine(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(year, month, month_start, month_end) of every month from one date's to another's."""
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(first).cast("date"), "MM"), F.trunc(F.lit(last).cast("date"), "MM"), F.expr("interval 1 month"))).alias("month_start"))
    return months.select(F.year("month_start").alias("year"), F.month("month_start").alias("month"), "month_start", F.last_day("month_start").alias("month_end"))


def month_windows(months: DataFrame, days: int = 7) -> DataFrame:
    """The windows of so many days that a month spine's months part into; the last of a month ends with it."""
    starts = months.select("year", "month", "month_end", F.explode(F.sequence("month_start", "month_end", F.expr(f"interval {days} days"))).alias("window_start"))
    return starts.select("year", "month", "window_start", F.least("month_end", F.date_add("window_start", days - 1)).alias("window_end"))


def previous_month(date: Column) -> tuple[Column, Column]:
    """First and last day of the month before a date's."""
    start = F.trunc(F.add_months(date, -1), "MM")
    return start, F.last_day(start)
