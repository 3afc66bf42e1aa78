"""Prices, averages, targets, backtests, metrics and grids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import backtest, grid, metrics, scans, snapshots
from ..operators.indicators import MASpec, add_averages, ema_fold
from ..operators.regimes import drawdown
from ..operators.signals import Both, MACrossover, TrendFilter, crossings, targets
from ..settings import SETTINGS
from ..sources import bars as prices
from ..sources import files
from .base import BH, INTERVALS_SQL, METRICS, averages_sql, bars, bars_sql, common_sql, compounded_sql, fresh, rounded, rounds_sql, summary_sql, table, targets_sql, with_sql

RULE = MACrossover(MASpec("sma", 20), MASpec("sma", 100))
EMA_RULE = MACrossover(MASpec("ema", 10), MASpec("sma", 200))
TREND_RULE = MACrossover(MASpec("sma", 10), MASpec("sma", 50), 200)
COST = 5.0
DAYS = ("1996-03-01", "1999-06-30")
SPLIT = "1996-01-02"
PRICE_COLS = ("open", "high", "low", "close", "adj_close", "volume")
_ALL = (*METRICS, *BH, "excess_total_return", "excess_cagr")
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


B = bars_sql()


@query("s0_bars_derived", with_sql(bars_sql(8), select=f"SELECT symbol, date, {rounds_sql(PRICE_COLS)} FROM bars"))
def bars_derived(spark, d):
    return rounded(bars(spark, d, 8).drop("source"))


_RAW = """raw AS (SELECT 'S' || CAST(o_custkey % 4 AS VARCHAR) symbol, CAST(o_orderdate AS DATE) AS date, o_totalprice AS open, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice + 1 END AS close, o_orderkey arrival FROM orders),
one AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY arrival DESC) r FROM raw)"""


@query("s2_normalise", with_sql(_RAW, select="SELECT symbol, date, open, close, open AS high, close AS low, open AS adj_close, CAST(1 AS DOUBLE) volume FROM one WHERE r = 1 AND open IS NOT NULL AND close IS NOT NULL"))
def normalise(spark, d):
    o = table(spark, d, "orders")
    close = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") + 1)
    raw = o.select(F.concat(F.lit("S"), (F.col("o_custkey") % 4).cast("string")).alias("symbol"), F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("open"), F.col("o_totalprice").alias("high"), close.alias("low"), close.alias("close"), F.col("o_totalprice").alias("adj_close"), F.lit(1.0).alias("volume"), F.col("o_orderkey").alias("arrival"))
    return prices.normalise(raw)


@query("s3_provenance", with_sql(B, select="SELECT symbol, arg_max(source, date) source FROM bars GROUP BY 1"))
def provenance(spark, d):
    return prices.provenance(bars(spark, d))


@query("p1_total_return", with_sql(B, select=f"SELECT symbol, date, {', '.join(f'round({c} * (adj_close / close), 8) {c}' for c in prices.PRICES)}, round(adj_close, 8) adj_close, volume FROM bars"))
def total_return(spark, d):
    return rounded(prices.on_basis(bars(spark, d), "total_return").drop("source"))


@query("p3_date_slice", with_sql(B, select=f"SELECT symbol, date, close FROM bars WHERE date BETWEEN DATE '{DAYS[0]}' AND DATE '{DAYS[1]}'"))
def date_slice(spark, d):
    return prices.between(bars(spark, d), *DAYS).select("symbol", "date", "close")


@query("p4_drop_incomplete", with_sql(B, select="SELECT symbol, date, close FROM bars WHERE date <> DATE '1998-03-04'"))
def drop_incomplete(spark, d):
    return prices.drop_incomplete(bars(spark, d), "1998-03-04 20:00:00", SETTINGS.session_complete_after).select("symbol", "date", "close")


_MAS = [MASpec("sma", 20), MASpec("sma", 50), MASpec("sma", 200)]


@query("w1_sma", with_sql(bars_sql(8), averages_sql(_MAS), select="SELECT symbol, date, round(sma20, 8) sma20, round(sma50, 8) sma50, round(sma200, 8) sma200 FROM m"))
def sma_query(spark, d):
    return rounded(add_averages(bars(spark, d, 8), _MAS).select("symbol", "date", "sma20", "sma50", "sma200"))


_EMAS = [MASpec("ema", 10), MASpec("ema", 50), MASpec("ema", 200)]


@query("w2_ema", with_sql(bars_sql(8), averages_sql(_EMAS), select="SELECT symbol, date, round(ema10, 4) ema10, round(ema50, 4) ema50, round(ema200, 4) ema200 FROM m"))
def ema_query(spark, d):
    """Prices are near 100,000: at 6 places the order in which doubles are added would show."""
    return rounded(add_averages(bars(spark, d, 8), _EMAS).select("symbol", "date", "ema10", "ema50", "ema200"), 4)


@query("w2_ema_fold", with_sql(bars_sql(8), averages_sql([MASpec("ema", 10)]), select="SELECT symbol, date, round(ema10, 6) ema10 FROM m"))
def ema_fold_query(spark, d):
    return rounded(bars(spark, d, 8).select("symbol", "date", ema_fold(10).alias("ema10")), 6)


@query("w4_returns", with_sql(B, select="SELECT symbol, date, round(lead(open) OVER w / open - 1, 8) next_open, round(ln(close / lag(close) OVER w), 8) log_return, round(close / lag(close) OVER w - 1, 8) pct_change FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)"))
def returns(spark, d):
    w = Window.partitionBy("symbol").orderBy("date")
    prev = F.lag("close").over(w)
    return rounded(bars(spark, d).select("symbol", "date", (F.lead("open").over(w) / F.col("open") - 1).alias("next_open"), F.ln(F.col("close") / prev).alias("log_return"), (F.col("close") / prev - 1).alias("pct_change")))


_SIGNALS = [RULE, EMA_RULE, TREND_RULE, TrendFilter(200), Both(RULE, TrendFilter(50))]


@query("f4_targets", with_sql(B, targets_sql(_SIGNALS), select="SELECT symbol, rule, date, target FROM t"))
def target_query(spark, d):
    return targets(bars(spark, d), _SIGNALS).select("symbol", "rule", "date", "target")


@query("w22_crossings", with_sql(B, targets_sql([RULE, EMA_RULE]), "x AS (SELECT *, target - lag(target) OVER (PARTITION BY symbol, rule ORDER BY date) step FROM t WHERE target IS NOT NULL)", select="SELECT symbol, rule, date, CAST(sign(step) AS INTEGER) crossing FROM x WHERE step <> 0"))
def crossing_query(spark, d):
    return crossings(targets(bars(spark, d), [RULE, EMA_RULE]))


_BT = (B, targets_sql([RULE]), INTERVALS_SQL, compounded_sql("iv", COST))


def _result(spark, d):
    return backtest.run(targets(bars(spark, d), [RULE]), COST)


@query("w6_turnover", with_sql(*_BT, select="SELECT symbol, rule, date, ends, exposure, turnover, round(ret, 8) ret, round(bh_ret, 8) bh_ret FROM eq"))
def turnover(spark, d):
    return rounded(_result(spark, d).select("symbol", "rule", "date", "ends", "exposure", "turnover", "ret", "bh_ret"))


@query("c1_backtest_curve", with_sql(*_BT, select="SELECT symbol, rule, date, 1.0::DOUBLE equity, 1.0::DOUBLE benchmark FROM eq WHERE first UNION ALL SELECT symbol, rule, ends, round(equity, 8), round(benchmark, 8) FROM eq"))
def curve(spark, d):
    return rounded(backtest.curve(_result(spark, d)))


@query("w23_trades", with_sql(*_BT, select="SELECT symbol, rule, date, CASE WHEN turnover > 0 THEN 'buy' ELSE 'sell' END side, abs(turnover) size, open price FROM eq WHERE turnover <> 0"))
def trade_query(spark, d):
    return backtest.trades(_result(spark, d))


@query("j16_equity_at_fills", with_sql(*_BT, "c AS (SELECT symbol, rule, date, 1.0::DOUBLE equity FROM eq WHERE first UNION ALL SELECT symbol, rule, ends, equity FROM eq)", select="SELECT e.symbol, e.rule, e.date, CASE WHEN turnover > 0 THEN 'buy' ELSE 'sell' END side, abs(turnover) size, open price, round(c.equity, 8) equity FROM eq e LEFT JOIN c ON c.symbol = e.symbol AND c.rule = e.rule AND c.date = e.date WHERE turnover <> 0"))
def equity_at_fills(spark, d):
    return rounded(backtest.equity_at_fills(_result(spark, d)))


@query("a8_summarise", with_sql(*_BT, summary_sql(), select=f"SELECT symbol, rule, {rounds_sql(_ALL)}, fills FROM sm"))
def summarise(spark, d):
    return rounded(metrics.summarise(_result(spark, d)))


@query("a9_metrics_table", with_sql(*_BT, summary_sql(), select=" UNION ALL ".join([f"SELECT symbol, rule, '{m}' metric, round({m}, 8) strategy, round(bh_{m}, 8) buy_and_hold FROM sm" for m in METRICS[:6]] + ["SELECT symbol, rule, 'time_in_market', round(time_in_market, 8), 1.0 FROM sm", "SELECT symbol, rule, 'fills', CAST(fills AS DOUBLE), 1.0 FROM sm"])))
def metrics_table(spark, d):
    return rounded(metrics.metrics_table(metrics.summarise(_result(spark, d))))


@query("a5_downside_deviation", with_sql(*_BT, select="SELECT symbol, rule, round(sqrt(avg(pow(least(ret, 0.0), 2))) * sqrt(252.0), 8) downside FROM eq GROUP BY 1, 2"))
def downside(spark, d):
    return rounded(_result(spark, d).groupBy("symbol", "rule").agg(metrics.downside_deviation("ret").alias("downside")))


_RULES = grid.default_rules()


_COUNTS = "cn AS (SELECT symbol, count(*) n FROM bars GROUP BY 1)"


@query("j11_rule_product", with_sql(bars_sql(70), _COUNTS, "k(kind) AS (VALUES ('sma'), ('ema'))", "s(n) AS (VALUES (10), (20), (50))", "l(n) AS (VALUES (100), (200))", select="SELECT cn.symbol, a.kind || s.n || '__' || b.kind || l.n AS rule, a.kind short_kind, s.n short_n, b.kind long_kind, l.n long_n FROM cn, k a, s, k b, l WHERE l.n <= cn.n"))
def rule_product(spark, d):
    """The rules for which each of 70 symbols has bars enough."""
    return grid.possible_rules(bars(spark, d, 70), _RULES).select("symbol", "rule", "short_kind", "short_n", "long_kind", "long_n")


_GRID = (B, targets_sql(_RULES), INTERVALS_SQL)


@query("w24_common_window", with_sql(*_GRID, common_sql(), select="SELECT symbol, min(date) opens, max(date) closes FROM cw GROUP BY 1"))
def common_window(spark, d):
    return grid.common_window(targets(bars(spark, d), _RULES))


@query("c3_strategy_grid", with_sql(*_GRID, common_sql(), compounded_sql("cw", COST), summary_sql(), select=f"SELECT symbol, rule, {rounds_sql(_ALL)}, fills FROM sm"))
def strategy_grid(spark, d):
    return rounded(grid.run_grid(bars(spark, d), _RULES, COST))


_WIDE = [MACrossover(MASpec("sma", a), MASpec("sma", b)) for a in (5, 10) for b in (20, 40)]


@query("c3_strategy_grid_symbols", with_sql(bars_sql(50), targets_sql(_WIDE), INTERVALS_SQL, common_sql(), compounded_sql("cw", COST), summary_sql(), select="SELECT symbol, rule, round(total_return, 6) total_return, round(max_drawdown, 6) max_drawdown, round(excess_total_return, 6) excess_total_return, fills FROM sm"))
def strategy_grid_symbols(spark, d):
    return rounded(grid.run_grid(bars(spark, d, 50), _WIDE, COST).select("symbol", "rule", "total_return", "max_drawdown", "excess_total_return", "fills"), 6)


@query("a10_count_beating", with_sql(*_GRID, common_sql(), compounded_sql("cw", COST), summary_sql(), select="SELECT symbol, CAST(count(*) FILTER (WHERE round(excess_total_return, 12) > 0) AS BIGINT) beating, count(*) rules FROM sm GROUP BY 1"))
def beating(spark, d):
    return metrics.count_beating(grid.run_grid(bars(spark, d), _RULES, COST))


@query("c5_evaluate", with_sql(B, targets_sql([EMA_RULE], "(SELECT * FROM bars WHERE date <= DATE '1999-12-31')"), INTERVALS_SQL, common_sql("1996-06-03"), compounded_sql("cw", COST), select="SELECT symbol, rule, date, round(equity, 8) equity, round(benchmark, 8) benchmark FROM eq"))
def evaluate(spark, d):
    return rounded(grid.evaluate(bars(spark, d), EMA_RULE, COST, "1996-06-03", "1999-12-31").select("symbol", "rule", "date", "equity", "benchmark"))


_HEAT = grid.heatmap_rules()
_HEAT_SQL = (B, targets_sql(_HEAT), INTERVALS_SQL, common_sql(), compounded_sql("cw", COST))
_CELLS = "cells AS (SELECT symbol, CAST(regexp_extract(rule, 'sma(\\d+)__', 1) AS INTEGER) short, CAST(regexp_extract(rule, '__sma(\\d+)', 1) AS INTEGER) long, arg_max(equity, date) - arg_max(benchmark, date) excess FROM eq GROUP BY symbol, rule)"


@query("j12_heatmap_pairs", with_sql(bars_sql(70), _COUNTS, "s AS (SELECT unnest(range(5, 61, 5)) n)", "l AS (SELECT unnest(range(100, 251, 10)) n)", select="SELECT cn.symbol, CAST(s.n AS INTEGER) short, CAST(l.n AS INTEGER) long FROM cn, s, l WHERE s.n < l.n AND l.n <= cn.n"))
def heatmap_pairs(spark, d):
    return grid.possible_rules(bars(spark, d, 70), _HEAT).select("symbol", F.col("short_n").alias("short"), F.col("long_n").alias("long"))


@query("c6_heatmap", with_sql(*_HEAT_SQL, _CELLS, select="SELECT symbol, short, long, round(excess, 8) excess FROM cells"))
def heat(spark, d):
    return rounded(grid.heatmap(bars(spark, d), _HEAT, COST))


_LONGS = list(range(100, 251, 50))


@query("l6_heatmap_pivot", with_sql(*_HEAT_SQL, _CELLS, select="SELECT symbol, short, " + ", ".join(f'round(max(CASE WHEN long = {n} THEN excess END), 8) AS "{n}"' for n in _LONGS) + " FROM cells GROUP BY 1, 2"))
def heat_pivot(spark, d):
    rules = [r for r in _HEAT if r.long.period in _LONGS]
    longest = max(_HEAT, key=lambda r: r.long.period)
    assert longest.long.period in _LONGS  # the window is the same as that of the whole heatmap
    return rounded(grid.pivoted(grid.heatmap(bars(spark, d), rules, COST), _LONGS))


@query("c7_rolling_start", with_sql(B, targets_sql([RULE]), INTERVALS_SQL, """kn AS (SELECT symbol, min(CASE WHEN target IS NOT NULL THEN date END) known, max(date) last FROM t GROUP BY 1),
ys AS (SELECT symbol, known, last, make_date(CAST(y AS INTEGER), 1, 1) start FROM kn, (SELECT unnest(range(1985, 2035)) y)),
st AS (SELECT symbol, start, CAST(start + INTERVAL 2 YEAR AS DATE) AS "end" FROM ys WHERE start >= known AND start + INTERVAL 2 YEAR <= last),
rw AS (SELECT iv.*, start, "end" FROM iv JOIN st ON iv.symbol = st.symbol AND date BETWEEN start AND "end")""", compounded_sql("rw", COST, 'symbol, start, "end"'), select='SELECT symbol, start, "end", round(arg_max(equity, date) - 1, 8) strategy, round(arg_max(benchmark, date) - 1, 8) buy_and_hold, round((arg_max(equity, date) - 1) - (arg_max(benchmark, date) - 1), 8) excess FROM eq GROUP BY 1, 2, 3'))
def rolling(spark, d):
    return rounded(grid.rolling_start(bars(spark, d), RULE, 2, COST))


def _part(end: bool) -> tuple:
    source = f"(SELECT * FROM bars WHERE date <= DATE '{SPLIT}')" if end else "bars"
    return (B, targets_sql([RULE], source), INTERVALS_SQL, common_sql(None if end else SPLIT), compounded_sql("cw", COST), summary_sql())


@query("c9_in_out_of_sample", f"SELECT * FROM ({with_sql(*_part(True), select=f'SELECT symbol, rule, {chr(39)}is{chr(39)} segment, {rounds_sql(_ALL)}, fills FROM sm')}) UNION ALL SELECT * FROM ({with_sql(*_part(False), select=f'SELECT symbol, rule, {chr(39)}oos{chr(39)} segment, {rounds_sql(_ALL)}, fills FROM sm')})")
def in_out(spark, d):
    out = grid.in_out_of_sample(bars(spark, d), RULE, SPLIT, None, COST)
    return rounded(out.select("symbol", "rule", "segment", *_ALL, "fills"))


B8 = bars_sql(8)
_BT8 = (B8, targets_sql([RULE]), INTERVALS_SQL, compounded_sql("iv", COST))


@query("c1_backtest_curve_symbols", with_sql(*_BT8, select="SELECT symbol, rule, date, 1.0::DOUBLE equity, 1.0::DOUBLE benchmark FROM eq WHERE first UNION ALL SELECT symbol, rule, ends, round(equity, 8), round(benchmark, 8) FROM eq"))
def curve_symbols(spark, d):
    return rounded(backtest.curve(backtest.run(targets(bars(spark, d, 8), [RULE]), COST)))


@query("c5_evaluate_symbols", with_sql(B8, targets_sql([EMA_RULE], "(SELECT * FROM bars WHERE date <= DATE '1999-12-31')"), INTERVALS_SQL, common_sql("1996-06-03"), compounded_sql("cw", COST), select="SELECT symbol, rule, date, round(equity, 8) equity, round(benchmark, 8) benchmark FROM eq"))
def evaluate_symbols(spark, d):
    return rounded(grid.evaluate(bars(spark, d, 8), EMA_RULE, COST, "1996-06-03", "1999-12-31").select("symbol", "rule", "date", "equity", "benchmark"))


@query("c6_heatmap_symbols", with_sql(B8, targets_sql(_HEAT), INTERVALS_SQL, common_sql(), compounded_sql("cw", COST), _CELLS, select="SELECT symbol, short, long, round(excess, 8) excess FROM cells"))
def heat_symbols(spark, d):
    return rounded(grid.heatmap(bars(spark, d, 8), _HEAT, COST))


@query("c7_rolling_start_symbols", SQL["c7_rolling_start"].replace(B.replace("AS (SELECT", "AS MATERIALIZED (SELECT"), B8.replace("AS (SELECT", "AS MATERIALIZED (SELECT")))
def rolling_symbols(spark, d):
    return rounded(grid.rolling_start(bars(spark, d, 8), RULE, 2, COST))


@query("c9_in_out_of_sample_symbols", SQL["c9_in_out_of_sample"].replace(B.replace("AS (SELECT", "AS MATERIALIZED (SELECT"), B8.replace("AS (SELECT", "AS MATERIALIZED (SELECT")))
def in_out_symbols(spark, d):
    out = grid.in_out_of_sample(bars(spark, d, 8), RULE, SPLIT, None, COST)
    return rounded(out.select("symbol", "rule", "segment", *_ALL, "fills"))


@query("f30_january_starts", with_sql(B, select="SELECT DISTINCT symbol, make_date(CAST(year(date) + 1 AS INTEGER), 1, 1) start FROM bars WHERE make_date(CAST(year(date) + 1 AS INTEGER), 1, 1) <= (SELECT max(date) FROM bars)"))
def january_starts(spark, d):
    span = bars(spark, d).groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    years = F.explode(F.sequence(F.make_date(F.year("a") + 1, F.lit(1), F.lit(1)), F.trunc("b", "year"), F.expr("INTERVAL 1 YEAR")))
    return span.select("symbol", years.alias("start"))


@query("f32_split_bounds", with_sql(B, select="SELECT symbol, DATE '1994-01-01' least, CAST(max(date) - INTERVAL 6 MONTH AS DATE) AS most, greatest(DATE '1994-01-01', CAST(max(date) - INTERVAL 6 MONTH AS DATE)) most_clamped FROM bars GROUP BY 1"))
def split_bounds(spark, d):
    return grid.split_bounds(bars(spark, d), "1993-01-01")


@query("a27_period_means", with_sql(B, select=f"SELECT symbol, year(date) AS year, count(*) n, round(avg(close), 6) mean_close, round(stddev_samp(close), 6) sd_close, min(low) low, max(high) high FROM bars WHERE date >= DATE '{DAYS[0]}' GROUP BY 1, 2"))
def period_means(spark, d):
    b = prices.between(bars(spark, d), DAYS[0])
    return rounded(b.groupBy("symbol", F.year("date").cast("long").alias("year")).agg(F.count("*").alias("n"), F.avg("close").alias("mean_close"), F.stddev_samp("close").alias("sd_close"), F.min("low").alias("low"), F.max("high").alias("high")), 6)


_Q = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


@query("a27_describe", with_sql(bars_sql(8), select=" UNION ALL ".join(f"SELECT symbol, '{c}' AS \"column\", count({c}) n, round(avg({c}), 6) mean, round(stddev_samp({c}), 6) sd, min({c}) low, " + ", ".join(f"quantile_cont({c}, {q}) {k}" for k, q in _Q.items()) + f", max({c}) high FROM bars GROUP BY 1" for c in ("close", "volume"))))
def describe(spark, d):
    return rounded(metrics.describe(bars(spark, d, 8), ("close", "volume")), 6)


_ROLL = "rr AS (SELECT symbol, rule, date, avg(ret) OVER w a, stddev_samp(ret) OVER w sd, count(*) OVER w n FROM eq WINDOW w AS (PARTITION BY symbol, rule ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"


@query("c18_rolling_metrics", with_sql(*_BT, _ROLL, select="SELECT symbol, rule, date, round(sd * sqrt(252.0), 6) volatility, round(CASE WHEN sd > 0 THEN a / sd * sqrt(252.0) END, 6) sharpe FROM rr WHERE n = 60"))
def rolling_metrics(spark, d):
    return rounded(metrics.rolling(_result(spark, d), 60), 6)


@query("c18_risk_return", with_sql(*_GRID, common_sql(), compounded_sql("cw", COST), summary_sql(), select="SELECT symbol, rule, round(cagr, 8) cagr, round(max_drawdown, 8) max_drawdown, round(sharpe, 8) sharpe, excess_total_return > 0 beats FROM sm"))
def risk_return(spark, d):
    return rounded(metrics.risk_return(grid.run_grid(bars(spark, d), _RULES, COST)))


@query("s3_prices_file", with_sql(bars_sql(8), select="SELECT symbol, date, close, 'file' source FROM bars"))
def prices_file(spark, d):
    """Written by the sink and read back."""
    path = fresh(spark, "prices")
    files.write_prices(bars(spark, d, 8), path, "file")
    return prices.read_prices(spark, path).select("symbol", "date", "close", "source")


@query("k4_meta_document", with_sql(B, select="SELECT 1 schema_version, symbol ticker, arg_max(source, date) source, '2001-09-01T00:00:00Z' last_refresh, min(date) first_trading_day, max(date) last_trading_day, count(*) prices, 1 detector_version FROM bars GROUP BY symbol"))
def meta_document(spark, d):
    path = fresh(spark, "meta.json")
    files.write_meta(spark, path, snapshots.document(bars(spark, d), "2001-09-01T00:00:00+00:00"))
    return files.read_meta(spark, path).select("schema_version", "ticker", "source", "last_refresh", "first_trading_day", "last_trading_day", "row_counts.prices", "detector_version")


def _long(spark, d):
    return prices.derive_long_bars(table(spark, d, "orders"))


@query("w1_sma_long", with_sql(B, averages_sql(_MAS), select="SELECT symbol, date, round(sma20, 8) sma20, round(sma50, 8) sma50, round(sma200, 8) sma200 FROM m"))
def sma_long(spark, d):
    """One series, cut to chunks that hang over."""
    b = scans.in_chunks(_long(spark, d), 199, lambda x: add_averages(x, _MAS))
    return rounded(b.select("symbol", "date", "sma20", "sma50", "sma200"))


@query("w2_ema_long", with_sql(B, averages_sql(_EMAS), select="SELECT symbol, date, round(ema10, 4) ema10, round(ema50, 4) ema50, round(ema200, 4) ema200 FROM m"))
def ema_long(spark, d):
    return rounded(scans.running(_long(spark, d), {s.label: scans.Scan("ema", "close", s.period) for s in _EMAS}).select("symbol", "date", "ema10", "ema50", "ema200"), 4)


@query("w7_compounding_long", with_sql(B, "pc AS (SELECT symbol, date, close / lag(close) OVER w - 1 ret FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))", select="SELECT symbol, date, round(product(1 + ret) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), 8) equity FROM pc WHERE ret IS NOT NULL"))
def compounding_long(spark, d):
    w = Window.partitionBy("symbol").orderBy("date")
    r = scans.lagged(_long(spark, d).select("symbol", "date", "close"), {"grown": F.col("close") / F.lag("close").over(w)}, 1).filter("grown IS NOT NULL")
    return rounded(scans.running(r, {"equity": scans.Scan("product", "grown")}).select("symbol", "date", "equity"))


@query("w8_drawdown_long", with_sql(B, select="SELECT symbol, date, round(close / max(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 8) drawdown FROM bars"))
def drawdown_long(spark, d):
    b = scans.running(_long(spark, d).select("symbol", "date", "close"), {"top": scans.Scan("max", "close")})
    return rounded(b.select("symbol", "date", (F.col("close") / F.col("top") - 1).alias("drawdown")))


@query("w8_drawdown", with_sql(bars_sql(8), select="SELECT symbol, date, round(close / max(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 8) drawdown FROM bars"))
def drawdown_query(spark, d):
    return rounded(drawdown(bars(spark, d, 8)).select("symbol", "date", "drawdown"))


@query("k8_snapshot_meta", with_sql(bars_sql(8), select="SELECT symbol, min(date) first_day, max(date) last_day, count(*) AS rows, arg_max(source, date) source, 1 detector_version FROM bars GROUP BY 1"))
def snapshot_meta(spark, d):
    return snapshots.meta(bars(spark, d, 8))
