"""Exchange sessions: business days without holidays, by rule; and what a snapshot lacks against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days on which the exchange was closed outside the rules.  Fixed values.
SPECIAL_CLOSURES = ("1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09")


def _nth(year: Column, month: int, day: str, n: int) -> Column:
    """The n-th weekday (MON, ...) of a month; n = -1: its last."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    if n > 0:
        return F.next_day(F.date_add(first, 7 * n - 8), day)
    return F.next_day(F.date_add(F.last_day(first), -7), day)


def _nearest(d: Column) -> Column:
    """Friday before a Saturday, Monday after a Sunday."""
    return F.when(F.weekday(d) == 5, F.date_add(d, -1)).when(F.weekday(d) == 6, F.date_add(d, 1)).otherwise(d)


def easter(y: Column) -> Column:
    """Easter Sunday of the Gregorian calendar, in whole numbers."""
    div = lambda a, b: F.floor(a / b)
    gold, century = y % 19, div(y, 100)
    moon = (19 * gold + century - div(century, 4) - div(8 * century + 13, 25) + 15) % 30
    moon = moon - div(moon, 28) * (1 - div(moon, 28) * div(F.lit(29), moon + 1) * div(21 - gold, 11))
    weekday = (y + div(y, 4) + moon + 2 - century + div(century, 4)) % 7
    past = moon - weekday  # days from March 28
    return F.date_add(F.make_date(y, F.lit(3), F.lit(28)), past.cast("int"))


def symbol_spans(bars: DataFrame) -> DataFrame:
    """symbol, lo, hi: each symbol's first and last bar."""
    return bars.groupBy("symbol").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))


def _span(spark: SparkSession, start: str, end: str) -> DataFrame:
    day = lambda x: F.lit(str(x)).cast("date")
    return spark.range(1).select(F.lit("").alias("symbol"), day(start).alias("lo"), day(end).alias("hi"))


def holidays_in(spans: DataFrame) -> DataFrame:
    """symbol, date, name of every holiday from lo to hi of a symbol's span."""
    y = F.col("y")
    on = lambda m, d: F.make_date(y, F.lit(m), F.lit(d))
    new_year = on(1, 1)
    rules = {
        "New Year": F.when(F.weekday(new_year) == 6, F.date_add(new_year, 1)).otherwise(new_year),
        "Martin Luther King": F.when(y >= 1998, _nth(y, 1, "MON", 3)),
        "Presidents": _nth(y, 2, "MON", 3),
        "Good Friday": F.date_add(easter(y), -2),
        "Memorial": _nth(y, 5, "MON", -1),
        "Juneteenth": F.when(y >= 2022, _nearest(on(6, 19))),
        "Independence": _nearest(on(7, 4)),
        "Labor": _nth(y, 9, "MON", 1),
        "Thanksgiving": _nth(y, 11, "THU", 4),
        "Christmas": _nearest(on(12, 25)),
    }
    years = spans.select("symbol", "lo", "hi", F.explode(F.sequence(F.year("lo") - 1, F.year("hi") + 1)).alias("y"))
    one = lambda date, name: F.struct(date.alias("date"), F.lit(name).alias("name"))
    ruled = years.select("symbol", "lo", "hi", F.inline(F.array(*[one(d, n) for n, d in rules.items()])))
    special = spans.select("symbol", "lo", "hi", F.inline(F.array(*[one(F.lit(d).cast("date"), "special closure") for d in SPECIAL_CLOSURES])))
    return ruled.unionByName(special).filter(F.col("date").between(F.col("lo"), F.col("hi"))).groupBy("symbol", "date").agg(F.min("name").alias("name"))


def business_days_in(spans: DataFrame) -> DataFrame:
    """symbol, date of every Monday to Friday from lo to hi."""
    return spans.select("symbol", F.explode(F.sequence("lo", "hi")).alias("date")).filter(F.weekday("date") < 5)


def sessions_in(spans: DataFrame) -> DataFrame:
    return business_days_in(spans).join(holidays_in(spans).select("symbol", "date"), ["symbol", "date"], "left_anti")


def holidays(spark: SparkSession, start: str, end: str) -> DataFrame:
    """date, name of every holiday from start to end."""
    return holidays_in(_span(spark, start, end)).drop("symbol")


def business_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    return business_days_in(_span(spark, start, end)).drop("symbol")


def sessions(spark: SparkSession, start: str, end: str) -> DataFrame:
    return sessions_in(_span(spark, start, end)).drop("symbol")


def missing_sessions(bars: DataFrame, session_days: DataFrame) -> DataFrame:
    """symbol, date of sessions without a bar between a symbol's first and last.

    Each symbol's stretch is spelled out in days, as many as the calendar has, which meet sessions and bars by equality.
    """
    days = F.explode(F.sequence("lo", "hi")).alias("date")
    due = bars.groupBy("symbol").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).select("symbol", days)
    return due.join(session_days.select("date"), "date", "left_semi").select("symbol", "date").join(bars.select("symbol", "date"), ["symbol", "date"], "left_anti")
