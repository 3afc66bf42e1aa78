"""Metrics of equity curves, as one aggregation per rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252
STRATEGY = ("total_return", "cagr", "max_drawdown", "sharpe", "sortino", "calmar")


def _safe(a: Column, b: Column, when: Column) -> Column:
    return F.when(when, a / b)


def of_curve(equity: str, ret: str, prefix: str = "") -> dict[str, Column]:
    """Aggregates of one curve: column equity at each interval's end, ret of the interval, deepest (its drawdown)."""
    last = F.max_by(equity, "date")
    years = F.datediff(F.max("ends"), F.min("date")) / F.lit(365.25)
    cagr = F.when((years > 0) & (last > 0), F.pow(last, 1 / F.when(years > 0, years)) - 1)
    sd, mean = F.stddev_samp(ret), F.avg(ret)
    down = F.sqrt(F.avg(F.pow(F.least(F.col(ret), F.lit(0.0)), 2))) * F.sqrt(F.lit(float(YEAR)))
    deepest = F.min(f"{equity}_dd")
    return {
        f"{prefix}total_return": last - 1,
        f"{prefix}cagr": cagr,
        f"{prefix}max_drawdown": deepest,
        f"{prefix}sharpe": _safe(mean, sd, sd > 0) * F.sqrt(F.lit(float(YEAR))),
        f"{prefix}sortino": _safe(mean * YEAR, down, down > 0),
        f"{prefix}calmar": _safe(cagr, F.abs(deepest), deepest < 0),
    }


def downside_deviation(ret: str) -> Column:
    """Annualised, over all returns; positive ones count as 0."""
    return F.sqrt(F.avg(F.pow(F.least(F.col(ret), F.lit(0.0)), 2))) * F.sqrt(F.lit(float(YEAR)))


def summarise(result: DataFrame, by: tuple[str, ...] = ("symbol", "rule")) -> DataFrame:
    """16 metrics per group of a backtest's intervals; undefined ones are null."""
    so_far = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    under = lambda c: F.col(c) / F.greatest(F.lit(1.0), F.max(c).over(so_far)) - 1
    d = result.withColumn("equity_dd", F.least(F.lit(0.0), under("equity"))).withColumn("benchmark_dd", F.least(F.lit(0.0), under("benchmark")))
    aggs = {**of_curve("equity", "ret"), "time_in_market": F.avg("exposure"), "fills": F.count_if(F.col("turnover") != 0), **of_curve("benchmark", "bh_ret", "bh_")}
    out = d.groupBy(*by).agg(*[c.alias(k) for k, c in aggs.items()])
    return out.withColumn("excess_total_return", F.col("total_return") - F.col("bh_total_return")).withColumn("excess_cagr", F.col("cagr") - F.col("bh_cagr"))


def summarise_folded(folded: DataFrame, names: list[str]) -> DataFrame:
    """What summarise() gives by symbol and rule, from backtest.folded() over rules of these names."""
    d = folded.select("symbol", "opens", "closes", "n", F.element_at("all", -1).alias("b"), F.posexplode(F.slice("all", 1, len(names))).alias("k", "a"))
    d = d.select("symbol", F.get(F.lit(names), F.col("k")).alias("rule"), "n", "a", "b", (F.datediff("closes", "opens") / F.lit(365.25)).alias("years"))

    def of(v: str, prefix: str) -> list[str]:
        cagr = f"CASE WHEN years > 0 AND {v}.e > 0 THEN pow({v}.e, 1 / CASE WHEN years > 0 THEN years END) - 1 END"
        sd = f"sqrt(greatest(({v}.q - {v}.s * {v}.s / n) / CASE WHEN n > 1 THEN n - 1 END, 0D))"
        down = f"sqrt({v}.w / n) * sqrt({YEAR}D)"
        return [
            f"{v}.e - 1 AS {prefix}total_return", f"{cagr} AS {prefix}cagr", f"{v}.dd AS {prefix}max_drawdown",
            f"CASE WHEN {sd} > 0 THEN {v}.s / n / {sd} END * sqrt({YEAR}D) AS {prefix}sharpe",
            f"CASE WHEN {down} > 0 THEN {v}.s / n * {YEAR} / ({down}) END AS {prefix}sortino",
            f"CASE WHEN {v}.dd < 0 THEN ({cagr}) / abs({v}.dd) END AS {prefix}calmar",
        ]

    out = d.selectExpr("symbol", "rule", *of("a", ""), "a.x / n AS time_in_market", "a.f AS fills", *of("b", "bh_"))
    return out.selectExpr("*", "total_return - bh_total_return AS excess_total_return", "cagr - bh_cagr AS excess_cagr")


def metrics_table(summary: DataFrame, by: tuple[str, ...] = ("symbol", "rule")) -> DataFrame:
    """by, metric, strategy, buy_and_hold in long form; buy and hold is always in the market and trades once."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("strategy"), F.col(f"bh_{m}").alias("buy_and_hold")) for m in STRATEGY]
    rows.append(F.struct(F.lit("time_in_market").alias("metric"), F.col("time_in_market").alias("strategy"), F.lit(1.0).alias("buy_and_hold")))
    rows.append(F.struct(F.lit("fills").alias("metric"), F.col("fills").cast("double").alias("strategy"), F.lit(1.0).alias("buy_and_hold")))
    return summary.select(*by, F.inline(F.array(*rows)))


def count_beating(summary: DataFrame, column: str = "excess_total_return") -> DataFrame:
    """Rules per symbol that beat buy and hold, of how many; excess is rounded first so that equal ones don't count."""
    return summary.groupBy("symbol").agg(F.count_if(F.round(column, 12) > 0).alias("beating"), F.count("*").alias("rules"))


def describe(df: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """by, column, n, mean, sd, low, quartiles and high of each column, in one aggregation."""
    one = lambda c: F.struct(
        F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).cast("double").alias("low"),
        *[F.percentile(c, q).alias(k) for k, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))], F.max(c).cast("double").alias("high"),
    )
    return df.groupBy(*by).agg(F.array(*map(one, columns)).alias("x")).select(*by, F.inline("x"))


def rolling(result: DataFrame, n: int, by: tuple[str, ...] = ("symbol", "rule")) -> DataFrame:
    """by, date, volatility and sharpe (annualised) of the last n returns, where there are n."""
    last = Window.partitionBy(*by).orderBy("date").rowsBetween(-(n - 1), 0)
    d = result.select(*by, "date", F.avg("ret").over(last).alias("mean"), F.stddev_samp("ret").over(last).alias("sd"), F.count("*").over(last).alias("n")).filter(F.col("n") == n)
    year = F.sqrt(F.lit(float(YEAR)))
    return d.select(*by, "date", (F.col("sd") * year).alias("volatility"), (_safe(F.col("mean"), F.col("sd"), F.col("sd") > 0) * year).alias("sharpe"))


def risk_return(summary: DataFrame, by: tuple[str, ...] = ("symbol", "rule")) -> DataFrame:
    """The points of a scatter of rules: return against risk, and whether the rule beats buy and hold."""
    return summary.select(*by, "cagr", "max_drawdown", "sharpe", (F.col("excess_total_return") > 0).alias("beats"))
