"""Drawdowns, spans under water, and headline figures of a close series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .indicators import by_date


def so_far():
    return by_date().rowsBetween(Window.unboundedPreceding, 0)


def with_positions(bars: DataFrame) -> DataFrame:
    """pos: the bar's number in its series from 0.  All distances are in these."""
    return bars.withColumn("pos", (F.row_number().over(by_date()) - 1).cast("long"))


def drawdown(bars: DataFrame, column: str = "close") -> DataFrame:
    """drawdown: value over running maximum less 1."""
    return bars.withColumn("drawdown", F.col(column) / F.max(column).over(so_far()) - 1)


def regime_spans(bars: DataFrame, threshold: float) -> DataFrame:
    """symbol, start, end of the longest runs of bars with drawdown at or below threshold."""
    d = with_positions(drawdown(bars)).filter(F.col("drawdown") <= threshold)
    island = F.col("pos") - F.row_number().over(by_date())
    return d.withColumn("island", island).groupBy("symbol", "island").agg(F.min("date").alias("start"), F.max("date").alias("end")).drop("island")


def all_spans(bars: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """regime_spans for several thresholds in one pass."""
    fan = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    d = with_positions(drawdown(bars)).select("symbol", "date", "pos", "drawdown", fan).filter("drawdown <= threshold")
    w = Window.partitionBy("symbol", "threshold").orderBy("pos")
    return d.withColumn("island", F.col("pos") - F.row_number().over(w)).groupBy("symbol", "threshold", "island").agg(F.min("date").alias("start"), F.max("date").alias("end")).drop("island")


def clip_spans(spans: DataFrame, start, end) -> DataFrame:
    """Spans that meet start to end, cut to it."""
    a, b = F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")
    return spans.filter((F.col("end") >= a) & (F.col("start") <= b)).withColumn("start", F.greatest("start", a)).withColumn("end", F.least("end", b))


def episodes_under_water(bars: DataFrame) -> DataFrame:
    """A row for each peak (restarting at equal highs) that is followed by lower bars: positions, dates, depth, recovery."""
    d = with_positions(bars.select("symbol", "date", "close")).withColumn("peak", F.max("close").over(so_far()))
    d = d.withColumn("grp", F.sum((F.col("close") == F.col("peak")).cast("long")).over(so_far())).withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    at = F.struct("close", "pos", "date")
    g = d.groupBy("symbol", "grp").agg(F.min(F.struct("pos", "date", "close")).alias("top"), F.min(at).alias("low"), F.max("n").alias("n"))
    nxt = F.lead("top").over(Window.partitionBy("symbol").orderBy("grp"))
    g = g.withColumn("back", nxt).filter("low.close < top.close")
    return g.select(
        "symbol", F.col("top.pos").alias("peak_pos"), F.col("top.date").alias("peak"), F.col("low.pos").alias("trough_pos"), F.col("low.date").alias("trough"),
        F.col("back.pos").alias("recovery_pos"), F.col("back.date").alias("recovery"),
        (F.col("low.close") / F.col("top.close") - 1).alias("depth"), "n",
    )


def drawdown_table(bars: DataFrame, top: int = 10) -> DataFrame:
    """The deepest per symbol, open ones included; days_underwater counts bars from peak to recovery or the last bar."""
    e = episodes_under_water(bars).withColumn("days_underwater", F.coalesce("recovery_pos", F.col("n") - 1) - F.col("peak_pos"))
    deepest = Window.partitionBy("symbol").orderBy("depth", "peak")
    e = e.withColumn("r", F.row_number().over(deepest)).filter(F.col("r") <= top)
    return e.select("symbol", F.col("r").alias("rank"), "peak", "trough", "recovery", "depth", "days_underwater")


def kpis(bars: DataFrame, vol_window: int = 20) -> DataFrame:
    """ytd_return, current_drawdown, distance_from_ath, realised_vol, ath_date per symbol, in one aggregation."""
    d = bars.withColumn("lr", F.when(F.lag("close").over(by_date()) > 0, F.ln(F.col("close") / F.lag("close").over(by_date()))))
    back = Window.partitionBy("symbol").orderBy(F.desc("date"))
    d = d.withColumn("r", F.row_number().over(back)).withColumn("this", F.year(F.max("date").over(Window.partitionBy("symbol"))))
    last, ath = F.max_by("close", "date"), F.max("close")
    prior = F.max_by(F.when(F.year("date") == F.col("this") - 1, F.col("close")), F.when(F.year("date") == F.col("this") - 1, F.col("date")))
    first = F.min_by(F.when(F.year("date") == F.col("this"), F.col("close")), F.when(F.year("date") == F.col("this"), F.col("date")))
    return d.groupBy("symbol").agg(
        (last / F.coalesce(prior, first) - 1).alias("ytd_return"),
        (last / ath - 1).alias("current_drawdown"),
        (ath / last - 1).alias("distance_from_ath"),
        (F.stddev_samp(F.when(F.col("r") <= vol_window, F.col("lr"))) * F.sqrt(F.lit(252.0))).alias("realised_vol"),
        F.min(F.struct((-F.col("close")).alias("c"), "date"))["date"].alias("ath_date"),
    )
