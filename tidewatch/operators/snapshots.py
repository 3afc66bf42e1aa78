"""Whether a new price snapshot may replace the old one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import SETTINGS, Settings
from ..sources.bars import PRICES
from .sessions import missing_sessions


def rewrites(old: DataFrame, new: DataFrame, tolerance: float) -> DataFrame:
    """symbol, column, changed, first_date: dates of both whose value moved by more than tolerance.  Volume may change."""
    both = old.alias("o").join(new.alias("n"), ["symbol", "date"])
    cols = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"o.{c}").alias("was"), F.col(f"n.{c}").alias("now")) for c in PRICES]))
    moved = (F.col("was") != 0) & (F.abs(F.col("now") / F.col("was") - 1) > tolerance)
    return both.select("symbol", "date", cols).filter(moved).groupBy("symbol", "column").agg(F.count("*").alias("changed"), F.min("date").alias("first_date"))


def factor_spread(old: DataFrame, new: DataFrame) -> DataFrame:
    """symbol, spread: how far the ratios of new to old adj_close lie apart; one constant factor has 0."""
    both = old.select("symbol", "date", F.col("adj_close").alias("a")).join(new.select("symbol", "date", F.col("adj_close").alias("b")), ["symbol", "date"]).filter("a <> 0 AND b <> 0")
    ratio = F.col("b") / F.col("a")
    return both.groupBy("symbol").agg((F.max(ratio) / F.min(ratio) - 1).alias("spread"))


def violations(old: DataFrame, new: DataFrame, session_days: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """symbol, check, detail: everything that is wrong with new; empty if it may be written."""
    size = lambda d, p: d.groupBy("symbol").agg(F.count("*").alias(f"{p}n"), F.max("date").alias(f"{p}last"))
    s = size(old, "o").join(size(new, "n"), "symbol", "left")
    said = lambda check, detail: (F.lit(check).alias("check"), detail.cast("string").alias("detail"))
    parts = [
        s.filter(F.coalesce("nn", F.lit(0)) < F.col("on")).select("symbol", *said("rows", F.concat_ws("<", "nn", "on"))),
        s.filter(F.col("nlast") < F.col("olast")).select("symbol", *said("last_date", F.concat_ws("<", "nlast", "olast"))),
        rewrites(old, new, settings.rewrite_tolerance).select("symbol", *said("rewrite", F.concat_ws(" ", "column", "changed", "first_date"))),
        factor_spread(old, new).filter(F.col("spread") > settings.factor_tolerance).select("symbol", *said("adj_factor", F.format_string("%.6f", "spread"))),
        missing_sessions(new, session_days).select("symbol", *said("missing_session", F.col("date"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validate(old: DataFrame, new: DataFrame, session_days: DataFrame, settings: Settings = SETTINGS) -> None:
    found = violations(old, new, session_days, settings).orderBy("symbol", "check", "detail").limit(10).collect()
    if found:
        raise ValueError("; ".join(f"{r.symbol} {r.check}: {r.detail}" for r in found))


def meta(bars: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """First and last day, rows, source and version per symbol, in one aggregation."""
    return bars.groupBy("symbol").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count("*").alias("rows"), F.max_by("source", "date").alias("source")).withColumn("detector_version", F.lit(settings.detector_version))


def document(bars: DataFrame, refreshed_at: str, schema_version: int = 1, settings: Settings = SETTINGS) -> DataFrame:
    """meta() as the fields of a snapshot's document, a row for each symbol; refreshed_at: a UTC time, told with a Z."""
    told = F.lit(refreshed_at.replace("+00:00", "Z"))
    return meta(bars, settings).select(
        F.lit(schema_version).alias("schema_version"), F.col("symbol").alias("ticker"), F.coalesce("source", F.lit("unknown")).alias("source"), told.alias("last_refresh"),
        F.col("first_day").alias("first_trading_day"), F.col("last_day").alias("last_trading_day"), F.struct(F.col("rows").alias("prices")).alias("row_counts"), "detector_version",
    )


def stale(refreshed: DataFrame, now_utc: str, settings: Settings = SETTINGS) -> DataFrame:
    """refreshed (symbol, refreshed_at) with age_days, whole days since then, and stale."""
    age = F.floor((F.unix_timestamp(F.lit(now_utc).cast("timestamp")) - F.unix_timestamp("refreshed_at")) / 86400)
    return refreshed.withColumn("age_days", age).withColumn("stale", F.col("age_days") > settings.stale_after_days)
