"""Long or cash, filled at the next open: every rule of every symbol in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import between
from .indicators import by_date
from .signals import Strategy

NO_HISTORY = "not enough history for the rules"


def intervals(target_frame: DataFrame) -> DataFrame:
    """Open-to-open return, exposure (yesterday's target) and the date at which each interval ends, on all bars."""
    w = Window.partitionBy("symbol", "rule").orderBy("date")
    return target_frame.select(
        "symbol", "rule", "date", "open", "target",
        (F.lead("open").over(w) / F.col("open") - 1).alias("r"),
        F.lag("target").over(w).alias("exposure"),
        F.lead("date").over(w).alias("ends"),
    )


def decided(averaged: DataFrame, rules: list[Strategy]) -> DataFrame:
    """symbol, date, open, now: the targets of all rules at a bar, as an array in their order."""
    told = [getattr(r, "text", None) for r in rules]
    now = F.expr(f"array({', '.join(told)})") if all(told) else F.array(*[r.target() for r in rules])
    return averaged.select("symbol", "date", "open", now.alias("now"))


def shared_intervals(bars: DataFrame, start=None, segment: Column | None = None) -> DataFrame:
    """Bars with targets from decided() -> the intervals of the window that all rules share, one row a bar.

    The window opens on the bar after the first on which every target is known, or at start, if later; rules must be
    steady (see signals.steady).  was: exposures, yesterday's targets; before: those of the interval before in the same
    window (and segment), null for its first.  All of it is windows over one symbol's bars: one shuffle, and no join.
    """
    w = by_date()
    known = F.bool_or(F.forall("now", lambda x: x.isNotNull())).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = bars.select("symbol", "date", "open", (F.lead("open").over(w) / F.col("open") - 1).alias("r"), F.lead("date").over(w).alias("ends"), F.lag("now").over(w).alias("was"), known.alias("known"))
    d = between(d.filter("known AND r IS NOT NULL").drop("known"), start)
    if segment is not None:
        d = d.withColumn("segment", segment).filter("segment IS NOT NULL")
    inside = Window.partitionBy("symbol", *(["segment"] if segment is not None else [])).orderBy("date")
    return d.withColumn("before", F.lag("was").over(inside))


def fanned(shared: DataFrame, rules: list[Strategy], cost_bps: float = 0.0) -> DataFrame:
    """shared_intervals() -> a row for each rule, with turnover and returns after cost taken from the bar's own arrays.

    So nothing is sorted by rule yet, and what only sums or multiplies returns needs no sort at all.
    """
    cost = F.lit(cost_bps / 1e4)
    none = F.array_repeat(F.lit(0.0), len(rules))
    pairs = F.posexplode(F.arrays_zip("was", F.coalesce("before", none).alias("before"))).alias("k", "x")
    more = [c for c in ("segment",) if c in shared.columns]
    d = shared.select("symbol", *more, "date", "open", "r", "ends", F.col("before").isNull().alias("first"), pairs)
    names = F.array(*[F.lit(r.name) for r in rules])
    d = d.select("symbol", *more, F.get(names, F.col("k")).alias("rule"), "date", "open", "r", "ends", "first", F.col("x.was").alias("exposure"), (F.col("x.was") - F.col("x.before")).alias("turnover"))
    ret = F.col("exposure") * F.col("r") - F.abs("turnover") * cost
    return d.withColumns({"ret": ret, "bh_ret": F.when(F.col("first"), F.col("r") - cost).otherwise(F.col("r"))})


#: Bars that are folded at once.
BLOCK = 64
#: What a fold keeps of a rule: equity, its highest and lowest (1 at the start included), the deepest drawdown, sums of returns, their
#: squares and the squares of losses, time in the market, fills.
_STEP = """named_struct('e', a.e * x.g, 'hi', greatest(a.hi, a.e * x.g), 'lo', least(a.lo, a.e * x.g), 'dd', least(a.dd, a.e * x.g / greatest(a.hi, a.e * x.g) - 1),
 's', a.s + x.ret, 'q', a.q + x.ret * x.ret, 'w', a.w + least(x.ret, 0D) * least(x.ret, 0D), 'x', a.x + x.was, 'f', a.f + if(x.turned, 1L, 0L))"""
_JOIN = """named_struct('e', a.e * b.e, 'hi', greatest(a.hi, a.e * b.hi), 'lo', least(a.lo, a.e * b.lo), 'dd', least(a.dd, b.dd, a.e * b.lo / a.hi - 1),
 's', a.s + b.s, 'q', a.q + b.q, 'w', a.w + b.w, 'x', a.x + b.x, 'f', a.f + b.f)"""
_NONE = "named_struct('e', 1D, 'hi', 1D, 'lo', 1D, 'dd', 0D, 's', 0D, 'q', 0D, 'w', 0D, 'x', 0D, 'f', 0L)"


def array_returns(shared: DataFrame, cost_bps: float = 0.0) -> DataFrame:
    """shared_intervals() with each, an array of all rules' return (and 1 more, g), exposure and whether it changed, of which the last is buy and hold's; and block, the number of its BLOCK of bars."""
    held = shared.withColumn("block", F.floor((F.row_number().over(by_date()) - 1) / BLOCK))
    before = "concat(coalesce(before, transform(was, x -> 0D)), array(if(before IS NULL, 0D, 1D)))"
    d = held.selectExpr("symbol", "block", "date", "ends", "r", "concat(was, array(1D)) was", f"{before} before")
    ret = f"a * r - abs(a - b) * {float(cost_bps / 1e4)!r}D"
    return d.selectExpr("symbol", "block", "date", "ends", f"zip_with(was, before, (a, b) -> named_struct('ret', {ret}, 'g', 1 + ({ret}), 'was', a, 'turned', a <> b)) each")


def last_equities(returns: DataFrame) -> DataFrame:
    """array_returns() -> symbol, last: the product of each rule's returns; buy and hold is the last."""
    product = "aggregate({0}, transform({0}[0], x -> 1D), (acc, y) -> zip_with(acc, y, (a, b) -> a * {1}))"
    blocks = returns.groupBy("symbol", "block").agg(F.collect_list("each").alias("rows")).selectExpr("symbol", product.format("rows", "b.g") + " AS e")
    return blocks.groupBy("symbol").agg(F.collect_list("e").alias("blocks")).selectExpr("symbol", product.format("blocks", "b") + " AS last")


def folded(returns: DataFrame) -> DataFrame:
    """array_returns() -> symbol, opens, closes, n, and all, what a fold keeps of each rule.

    A block of bars is folded to a summary of each rule, and a symbol's summaries in the order of time to one: a drawdown
    from a top in one block to a low in a later one is told by the top so far and the lowest of the later one.
    """
    fold = "aggregate({0}, transform({0}[0].{1}, x -> {2}), (acc, y) -> zip_with(acc, y.{1}, (a, {3}) -> {4}))"
    b = returns.groupBy("symbol", "block").agg(F.array_sort(F.collect_list(F.struct("date", "each"))).alias("rows"), F.min("date").alias("opens"), F.max("ends").alias("closes"), F.count("*").alias("n"))
    b = b.selectExpr("symbol", "block", "opens", "closes", "n", fold.format("rows", "each", _NONE, "x", _STEP) + " AS kept")
    s = b.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("block", "kept"))).alias("blocks"), F.min("opens").alias("opens"), F.max("closes").alias("closes"), F.sum("n").alias("n"))
    return s.selectExpr("symbol", "opens", "closes", "n", fold.format("blocks", "kept", _NONE, "b", _JOIN) + " AS all")


def with_equity(returns: DataFrame, by: tuple[str, ...] = ("symbol", "rule")) -> DataFrame:
    """equity and benchmark at each interval's end."""
    so_far = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumns({"equity": F.product(1 + F.col("ret")).over(so_far), "benchmark": F.product(1 + F.col("bh_ret")).over(so_far)})


def compounded(windowed: DataFrame, cost_bps: float = 0.0, by: tuple[str, ...] = ("symbol", "rule")) -> DataFrame:
    """Intervals of a window -> turnover, returns after cost, equity and benchmark at each interval's end.

    Turnover is measured inside the window, so entering it costs; the benchmark pays for one entry.
    """
    w = Window.partitionBy(*by).orderBy("date")
    cost = cost_bps / 1e4
    d = windowed.filter("r IS NOT NULL AND exposure IS NOT NULL")
    d = d.withColumn("turnover", F.col("exposure") - F.coalesce(F.lag("exposure").over(w), F.lit(0.0))).withColumn("first", F.lag("date").over(w).isNull())
    d = d.withColumn("ret", F.col("exposure") * F.col("r") - F.abs("turnover") * F.lit(cost))
    d = d.withColumn("bh_ret", F.when(F.col("first"), F.col("r") - F.lit(cost)).otherwise(F.col("r")))
    return with_equity(d, by)


def run(target_frame: DataFrame, cost_bps: float = 0.0, start=None, end=None) -> DataFrame:
    """compounded() over the bars from start to end; lags and leads look beyond the window, turnover doesn't."""
    if cost_bps < 0:
        raise ValueError("cost_bps must not be negative")
    return compounded(between(intervals(target_frame), start, end), cost_bps)


def curve(result: DataFrame) -> DataFrame:
    """symbol, rule, date, equity, benchmark: 1 at the first interval's start, then values at each next open."""
    first = result.filter("first").select("symbol", "rule", "date", F.lit(1.0).alias("equity"), F.lit(1.0).alias("benchmark"))
    return first.unionByName(result.select("symbol", "rule", F.col("ends").alias("date"), "equity", "benchmark"))


def trades(result: DataFrame) -> DataFrame:
    """symbol, rule, date, side, size, price (that day's open): where exposure changes."""
    side = F.when(F.col("turnover") > 0, "buy").otherwise("sell")
    return result.filter("turnover <> 0").select("symbol", "rule", "date", side.alias("side"), F.abs("turnover").alias("size"), F.col("open").alias("price"))


def equity_at_fills(result: DataFrame) -> DataFrame:
    """Trades with the equity on their dates."""
    at = curve(result).select("symbol", "rule", "date", "equity")
    return trades(result).join(at, ["symbol", "rule", "date"], "left")


def require_rows(df: DataFrame, message: str = NO_HISTORY) -> DataFrame:
    """df, or ValueError if it is empty.  Runs a job of one row."""
    if not df.limit(1).count():
        raise ValueError(message)
    return df
