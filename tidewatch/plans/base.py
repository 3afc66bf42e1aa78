"""What the queries and their SQL share: tables, derived bars, and SQL for averages, targets and backtests."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.indicators import MASpec
from ..sources.bars import derive_bars

#: Decimal places at which figures are held against each other.
PLACES = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, symbols: int = 1) -> DataFrame:
    return derive_bars(table(spark, sf_dir, "orders"), symbols)


def fresh(spark: SparkSession, what: str) -> str:
    """A new path in the folder that the cluster shares; a local one where no folder is named, for a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{what}"


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Doubles rounded; all else as it is."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(x: Column, places: int = PLACES) -> Column:
    return F.round(x, places)


def bars_sql(symbols: int = 1) -> str:
    return f"""bd AS (SELECT 'S' || CAST(o_custkey % {symbols} AS VARCHAR) symbol, CAST(o_orderdate AS DATE) AS date, min(o_custkey) k, max(o_orderkey) x, count(*) n FROM orders GROUP BY 1, 2),
bs AS (SELECT symbol, date, n, ((k*7919 + x*104729) % 2003 - 1001) * CASE WHEN (x*7877 + k*31) % 97 = 0 THEN 6 ELSE 1 END + 25 step, ((k*15485 + x*32452) % 1009 - 504) * 4 gap FROM bd),
bc AS (SELECT *, 100000 + sum(step) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) close_t FROM bs),
bo AS (SELECT symbol, date, n, CAST(close_t AS DOUBLE) c, CAST(coalesce(lag(close_t) OVER (PARTITION BY symbol ORDER BY date), 100000) + gap AS DOUBLE) o,
              (1000 - 5 * (max(year(date)) OVER (PARTITION BY symbol) - year(date))) / 1000.0::DOUBLE f FROM bc),
bars AS (SELECT symbol, date, o AS open, greatest(o, c) high, least(o, c) low, c AS close, c * f AS adj_close, CAST(n AS DOUBLE) volume, 'orders' source FROM bo)"""


def averages_sql(specs: list[MASpec], source: str = "bars") -> str:
    """CTE m: source with a column for each spec."""
    specs = sorted(set(specs))
    smas = [s.period for s in specs if s.kind == "sma"]
    emas = [s.period for s in specs if s.kind == "ema"]
    frame = "OVER (PARTITION BY p.symbol ORDER BY p.date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
    cols = "".join(f", CASE WHEN count(close) {frame.format(n - 1)} = {n} THEN avg(close) {frame.format(n - 1)} END sma{n}" for n in smas)
    out = f"pn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) rn FROM {source}),\n"
    join = ""
    if emas:
        a = {n: repr(2.0 / (n + 1)) for n in emas}
        out += f"em AS (SELECT symbol, rn, {', '.join(f'close e{n}' for n in emas)} FROM pn WHERE rn = 1 UNION ALL SELECT p.symbol, p.rn, "
        out += ", ".join(f"CAST({a[n]} AS DOUBLE) * p.close + (1 - CAST({a[n]} AS DOUBLE)) * em.e{n}" for n in emas)
        out += " FROM em JOIN pn p ON p.symbol = em.symbol AND p.rn = em.rn + 1),\n"
        join = " JOIN em ON em.symbol = p.symbol AND em.rn = p.rn"
        cols += "".join(f", CASE WHEN p.rn >= {n} THEN em.e{n} END ema{n}" for n in emas)
    return out + f"m AS (SELECT p.*{cols} FROM pn p{join})"


def target_sql(rule) -> str:
    from ..operators.signals import Both, MACrossover, TrendFilter

    if isinstance(rule, Both):
        a, b = target_sql(rule.a), target_sql(rule.b)
        return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL ELSE least({a}, {b}) END"
    if isinstance(rule, TrendFilter):
        return f"CAST(close > sma{rule.period} AS DOUBLE)"
    assert isinstance(rule, MACrossover)
    t = f"CAST({rule.short.label} > {rule.long.label} AS DOUBLE)"
    if rule.trend is None:
        return t
    return f"CASE WHEN {t} IS NULL OR sma{rule.trend} IS NULL THEN NULL ELSE least({t}, CAST(close > sma{rule.trend} AS DOUBLE)) END"


def targets_sql(rules, source: str = "bars") -> str:
    """CTE t: symbol, rule, date, open, close, target."""
    specs = [s for rule in rules for s in rule.needs()]
    fan = ", ".join(f"{{'rule': '{x.name}', 'target': {target_sql(x)}}}" for x in rules)
    return averages_sql(specs, source) + f",\nt AS (SELECT symbol, u.rule, date, open, close, u.target FROM (SELECT symbol, date, open, close, unnest([{fan}]) u FROM m))"


INTERVALS_SQL = """iv AS (SELECT symbol, rule, date, open, target, lead(open) OVER w / open - 1 r, lag(target) OVER w exposure, lead(date) OVER w ends
       FROM t WINDOW w AS (PARTITION BY symbol, rule ORDER BY date))"""


def common_sql(start: str | None = None) -> str:
    """CTE cw: the intervals in the window all rules share."""
    after = f" AND date >= DATE '{start}'" if start else ""
    return f"""fv AS (SELECT symbol, max(f) slowest FROM (SELECT symbol, rule, min(CASE WHEN target IS NOT NULL THEN date END) f FROM t GROUP BY 1, 2) GROUP BY 1 HAVING count(*) = count(f)),
cw AS (SELECT iv.* FROM iv JOIN fv ON iv.symbol = fv.symbol WHERE date > slowest{after})"""


def compounded_sql(source: str = "cw", cost_bps: float = 0.0, by: str = "symbol, rule") -> str:
    """CTE eq: turnover, returns, equity and benchmark."""
    cost = f"CAST({cost_bps / 1e4!r} AS DOUBLE)"
    return f"""k0 AS (SELECT * FROM {source} WHERE r IS NOT NULL AND exposure IS NOT NULL),
k1 AS (SELECT *, exposure - coalesce(lag(exposure) OVER w, 0) turnover, lag(date) OVER w IS NULL first FROM k0 WINDOW w AS (PARTITION BY {by} ORDER BY date)),
k2 AS (SELECT *, exposure * r - abs(turnover) * {cost} ret, CASE WHEN first THEN r - {cost} ELSE r END bh_ret FROM k1),
eq AS (SELECT *, product(1 + ret) OVER w equity, product(1 + bh_ret) OVER w benchmark FROM k2 WINDOW w AS (PARTITION BY {by} ORDER BY date ROWS UNBOUNDED PRECEDING))"""


def summary_sql(by: str = "symbol, rule") -> str:
    """CTE sm: the 16 metrics of eq."""

    def one(e: str, ret: str, p: str) -> str:
        years = "(date_diff('day', min(date), max(ends)) / 365.25)"
        return f"""arg_max({e}, date) - 1 {p}total_return, pow(arg_max({e}, date), 1 / {years}) - 1 {p}cagr, min({e}_dd) {p}max_drawdown,
CASE WHEN stddev_samp({ret}) > 0 THEN avg({ret}) / stddev_samp({ret}) * sqrt(252.0) END {p}sharpe,
CASE WHEN avg(pow(least({ret}, 0.0), 2)) > 0 THEN avg({ret}) * 252 / (sqrt(avg(pow(least({ret}, 0.0), 2))) * sqrt(252.0)) END {p}sortino,
CASE WHEN min({e}_dd) < 0 THEN (pow(arg_max({e}, date), 1 / {years}) - 1) / abs(min({e}_dd)) END {p}calmar"""

    return f"""ed AS (SELECT *, least(0.0, equity / greatest(1.0, max(equity) OVER w) - 1) equity_dd, least(0.0, benchmark / greatest(1.0, max(benchmark) OVER w) - 1) benchmark_dd
       FROM eq WINDOW w AS (PARTITION BY {by} ORDER BY date ROWS UNBOUNDED PRECEDING)),
s0 AS (SELECT {by}, {one('equity', 'ret', '')}, avg(exposure) time_in_market, CAST(count(*) FILTER (WHERE turnover <> 0) AS BIGINT) fills, {one('benchmark', 'bh_ret', 'bh_')} FROM ed GROUP BY {by}),
sm AS (SELECT *, total_return - bh_total_return excess_total_return, cagr - bh_cagr excess_cagr FROM s0)"""


METRICS = ("total_return", "cagr", "max_drawdown", "sharpe", "sortino", "calmar", "time_in_market")
BH = tuple(f"bh_{m}" for m in METRICS[:6])


def rounds_sql(names, places: int = PLACES) -> str:
    return ", ".join(f"round({n}, {places}) {n}" for n in names)


def with_sql(*ctes: str, select: str) -> str:
    """The CTEs, each computed once (but for the recursive one), and the query over them."""
    once = re.sub(r"\b(?!em\b)(\w+)(\([\w, ]+\))? AS \((?=SELECT|VALUES)", r"\1\2 AS MATERIALIZED (", ",\n".join(ctes))
    return f"WITH RECURSIVE {once}\n{select}"
