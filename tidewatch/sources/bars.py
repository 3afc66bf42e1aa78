"""Daily bars: schema, normalising, re-basing, and bars derived from an orders table.

Every frame has a symbol; all windows are partitioned by it, so many series run side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close")
BAR_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in (*PRICES, "adj_close", "volume")]
    + [T.StructField("source", T.StringType())]
)


def normalise(raw: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Dates without time, one bar per symbol and date (the last to arrive), then no bar without open or close.

    The order matters: a last bar with a null close removes its date.
    """
    day = raw.withColumn("date", F.to_date("date"))
    last = Window.partitionBy("symbol", "date").orderBy(F.desc(arrival))
    kept = day.withColumn("_r", F.row_number().over(last)).filter("_r = 1")
    return kept.filter(F.col("open").isNotNull() & F.col("close").isNotNull()).select("symbol", "date", *PRICES, "adj_close", "volume")


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Bars as written by the sinks; a missing source is "unknown"."""
    from .files import read_table

    return read_table(spark, path, BAR_SCHEMA).withColumn("source", F.coalesce("source", F.lit("unknown")))


def provenance(bars: DataFrame) -> DataFrame:
    """The source of each symbol's last bar."""
    return bars.groupBy("symbol").agg(F.max_by("source", "date").alias("source"))


def total_return(bars: DataFrame) -> DataFrame:
    """Open to close times adj_close / close; adj_close and volume as they are.  A zero close has no factor."""
    factor = F.when(F.col("close") != 0, F.col("adj_close") / F.col("close"))
    return bars.withColumn("_f", factor).withColumns({c: F.col(c) * F.col("_f") for c in PRICES}).drop("_f")


def on_basis(bars: DataFrame, basis: str) -> DataFrame:
    if basis == "total_return":
        return total_return(bars)
    if basis == "price_only":
        return bars
    raise ValueError(f"unknown basis {basis!r}: total_return or price_only")


def between(bars: DataFrame, start=None, end=None) -> DataFrame:
    """Dates from start to end, both included; neither need be a bar's."""
    out = bars
    if start is not None:
        out = out.filter(F.col("date") >= F.lit(str(start)).cast("date"))
    if end is not None:
        out = out.filter(F.col("date") <= F.lit(str(end)).cast("date"))
    return out


def in_new_york(now: Column) -> Column:
    return F.from_utc_timestamp(now, "America/New_York")


def drop_incomplete(bars: DataFrame, now_utc: str, complete_after: str) -> DataFrame:
    """Without each symbol's last bar where it is today's in New York and the session isn't over.  now_utc: a UTC time."""
    there = in_new_york(F.lit(now_utc).cast("timestamp"))
    open_still = F.date_format(there, "HH:mm") < F.lit(complete_after)
    return bars.filter(~((F.col("date") == F.to_date(there)) & open_still))


def derive_bars(orders: DataFrame, symbols: int = 1) -> DataFrame:
    """Bars by an exact walk in whole ticks from an orders table; symbol: customer number modulo symbols.

    One aggregation by symbol and day, then windows over days.  adj_close falls by five thousandths a year back
    from the last.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    s = _steps(orders, symbols)
    s = s.withColumn("walked", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return _walked(s.withColumn("last_year", F.max(F.year("date")).over(Window.partitionBy("symbol"))))


def derive_long_bars(orders: DataFrame, symbols: int = 1) -> DataFrame:
    """derive_bars() for few and long series: a symbol's days are dealt to many tasks."""
    from ..operators.scans import Scan, running

    s = _steps(orders, symbols)
    last = s.groupBy("symbol").agg(F.max(F.year("date")).alias("last_year"))
    return _walked(running(s, {"walked": Scan("sum", "step")}).join(last, "symbol"))


def _steps(orders: DataFrame, symbols: int) -> DataFrame:
    day = F.to_date("o_orderdate")
    symbol = F.concat(F.lit("S"), (F.col("o_custkey") % symbols).cast("string"))
    d = orders.groupBy(symbol.alias("symbol"), day.alias("date")).agg(F.min("o_custkey").alias("k"), F.max("o_orderkey").alias("x"), F.count("*").alias("n"))
    u, v, jump = (F.col("k") * 7919 + F.col("x") * 104729) % 2003, (F.col("k") * 15485 + F.col("x") * 32452) % 1009, (F.col("x") * 7877 + F.col("k") * 31) % 97
    step = (u - 1001) * F.when(jump == 0, 6).otherwise(1) + 25
    return d.select("symbol", "date", "n", step.alias("step"), ((v - 504) * 4).alias("gap"))


def _walked(s: DataFrame) -> DataFrame:
    s = s.withColumn("close_t", F.lit(100000) + F.col("walked"))
    s = s.withColumn("open_t", F.col("close_t") - F.col("step") + F.col("gap"))
    s = s.withColumn("factor", (F.lit(1000) - 5 * (F.col("last_year") - F.year("date"))) / F.lit(1000.0))
    c, o = F.col("close_t").cast("double"), F.col("open_t").cast("double")
    return s.select("symbol", "date", o.alias("open"), F.greatest(o, c).alias("high"), F.least(o, c).alias("low"), c.alias("close"), (c * F.col("factor")).alias("adj_close"), F.col("n").cast("double").alias("volume"), F.lit("orders").alias("source"))
