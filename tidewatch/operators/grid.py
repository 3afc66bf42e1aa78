"""Grids of rules: ranking, heatmap, rolling starts, in and out of sample."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..settings import SETTINGS, Settings
from ..sources.bars import between
from . import backtest, metrics
from .indicators import MASpec, by_date
from .signals import MACrossover, Strategy, steady, targets, with_averages


def default_rules(settings: Settings = SETTINGS) -> list[MACrossover]:
    """Every kind and short period against every kind and long period: 24."""
    short = [MASpec(k, n) for k in settings.ma_kinds for n in settings.short_periods]
    long = [MASpec(k, n) for k in settings.ma_kinds for n in settings.long_periods]
    return [MACrossover(a, b) for a, b in product(short, long)]


def heatmap_rules(kinds: tuple[str, str] = ("sma", "sma"), settings: Settings = SETTINGS) -> list[MACrossover]:
    """Pairs of periods of inclusive ranges with short below long: 192."""
    steps = lambda r: range(r[0], r[1] + 1, r[2])
    return [MACrossover(MASpec(kinds[0], a), MASpec(kinds[1], b)) for a, b in product(steps(settings.heatmap_short), steps(settings.heatmap_long)) if a < b]


def possible_rules(bars: DataFrame, rules: list[MACrossover]) -> DataFrame:
    """symbol, rule and its averages, for the rules whose longest average each symbol has bars enough for."""
    one = lambda r: F.struct(
        F.lit(r.name).alias("rule"), F.lit(r.short.kind).alias("short_kind"), F.lit(r.short.period).alias("short_n"), F.lit(r.long.kind).alias("long_kind"), F.lit(r.long.period).alias("long_n"),
        F.lit(max(x.period for x in r.needs())).alias("longest"),
    )
    counted = bars.groupBy("symbol").agg(F.count("*").alias("n"))
    return counted.select("symbol", "n", F.inline(F.array(*map(one, rules)))).filter("longest <= n").drop("n", "longest")


def common_window(target_frame: DataFrame, start=None, days: DataFrame | None = None) -> DataFrame:
    """symbol, opens, closes: from the bar after the slowest rule's first target (or start, if later) to the last bar.

    target_frame: symbol, rule, date, target; days: symbol and date of the bars, where at hand.  Symbols on which some rule
    never has a target, or where no bar is left, have no row.
    """
    first = target_frame.groupBy("symbol", "rule").agg(F.min(F.when(F.col("target").isNotNull(), F.col("date"))).alias("first"))
    slow = first.groupBy("symbol").agg(F.max("first").alias("slowest"), F.count_if(F.col("first").isNull()).alias("never")).filter("never = 0")
    days = target_frame.select("symbol", "date").distinct() if days is None else days
    after = days.join(slow, "symbol").groupBy("symbol").agg(F.min(F.when(F.col("date") > F.col("slowest"), F.col("date"))).alias("opens"), F.max("date").alias("closes"))
    opens = F.col("opens") if start is None else F.greatest("opens", F.lit(str(start)).cast("date"))
    return after.filter("opens IS NOT NULL").select("symbol", opens.alias("opens"), "closes").filter("opens <= closes")


def run_grid(bars: DataFrame, rules: list[Strategy], cost_bps: float = 0.0, start=None, end=None) -> DataFrame:
    """All metrics of every rule over the window they share, best excess first.

    Rules stay arrays to the end: a symbol's bars are folded in blocks, and no bar is fanned out.
    """
    if all(map(steady, rules)):
        returns = backtest.array_returns(backtest.shared_intervals(_bars(bars, rules, end), start), cost_bps)
        out = metrics.summarise_folded(backtest.folded(returns), [r.name for r in rules])
    else:
        out = metrics.summarise(_compounded(bars, rules, cost_bps, start, end))
    # a sort by ranges samples its input first: what was folded is dealt out before, or it would be folded twice
    return out.repartition("symbol").orderBy(F.desc("excess_total_return"), "rule")


def _bars(bars: DataFrame, rules: list[Strategy], end=None) -> DataFrame:
    return backtest.decided(with_averages(between(bars, end=end), rules), rules)


def _compounded(bars: DataFrame, rules: list[Strategy], cost_bps: float, start, end) -> DataFrame:
    """Intervals with equity, over the window that the rules share."""
    if all(map(steady, rules)):
        return backtest.with_equity(backtest.fanned(backtest.shared_intervals(_bars(bars, rules, end), start), rules, cost_bps))
    frame = targets(between(bars, end=end), rules)
    windowed = backtest.intervals(frame).join(common_window(frame, start), "symbol").filter("date >= opens").drop("opens", "closes")
    return backtest.compounded(windowed, cost_bps)


def evaluate(bars: DataFrame, rule: Strategy, cost_bps: float = 0.0, start=None, end=None) -> DataFrame:
    """One rule over its own window; intervals with equity."""
    return _compounded(bars, [rule], cost_bps, start, end)


def heatmap(bars: DataFrame, rules: list[MACrossover] | None = None, cost_bps: float = 0.0, start=None, end=None) -> DataFrame:
    """symbol, short, long, excess: only the excess, each distinct average once.

    The last equity is the product of all returns, taken element by element of the rules' array in blocks of bars.
    """
    rules = rules or heatmap_rules()
    if not all(map(steady, rules)):
        raise ValueError("the rules' targets have to stay known once they are")
    last = backtest.last_equities(backtest.array_returns(backtest.shared_intervals(_bars(bars, rules, end), start), cost_bps))
    pairs = F.expr(f"array({', '.join(f'named_struct({chr(39)}short{chr(39)}, {r.short.period}, {chr(39)}long{chr(39)}, {r.long.period})' for r in rules)})")
    out = last.select("symbol", F.element_at("last", -1).alias("held"), F.posexplode(F.slice("last", 1, len(rules))).alias("k", "e"))
    return out.select("symbol", F.get(pairs, F.col("k")).alias("at"), (F.col("e") - F.col("held")).alias("excess")).select("symbol", "at.short", "at.long", "excess")


def pivoted(cells: DataFrame, longs: list[int]) -> DataFrame:
    """The heatmap as a matrix: a row for each short period, a column for each long one."""
    return cells.groupBy("symbol", "short").pivot("long", longs).agg(F.first("excess")).orderBy("symbol", "short")


def rolling_start(bars: DataFrame, rule: Strategy, horizon_years: int = SETTINGS.horizon_years, cost_bps: float = 0.0) -> DataFrame:
    """symbol, start, end, strategy, buy_and_hold, excess for each January 1st that leaves horizon_years of data.

    Bars aren't cut at end, so the last interval ends on the bar after it.  An interval lies in horizon_years starts:
    starts come from its own date, so there is no range join.
    """
    w, every = by_date(), Window.partitionBy("symbol")
    bar = _bars(bars, [rule]).select(
        "symbol", "date", "open", (F.lead("open").over(w) / F.col("open") - 1).alias("r"), F.lead("date").over(w).alias("ends"), F.element_at(F.lag("now").over(w), 1).alias("exposure"),
        F.min(F.when(F.element_at("now", 1).isNotNull(), F.col("date"))).over(every).alias("known"), F.max("date").over(every).alias("last"),
    )
    d = bar.filter("r IS NOT NULL AND exposure IS NOT NULL")
    years = F.explode(F.sequence(F.year("date") - horizon_years, F.year("date")))
    d = d.withColumn("year", years).withColumn("start", F.make_date("year", F.lit(1), F.lit(1))).drop("year")
    d = d.withColumn("end", F.add_months("start", 12 * horizon_years))
    d = d.filter("date BETWEEN start AND end AND start >= known AND end <= last")
    by = ("symbol", "start", "end")
    out = backtest.compounded(d, cost_bps, by).groupBy(*by).agg((F.max_by("equity", "date") - 1).alias("strategy"), (F.max_by("benchmark", "date") - 1).alias("buy_and_hold"))
    return out.withColumn("excess", F.col("strategy") - F.col("buy_and_hold"))


def in_out_of_sample(bars: DataFrame, rule: Strategy, split, start=None, cost_bps: float = 0.0) -> DataFrame:
    """Metrics with segment "is" (start to split) and "oos" (split to the last bar), in one pass over the bars.

    An interval is in sample if it ends by split and out of sample if it begins there or later; turnover is measured
    inside each.  A symbol whose window doesn't hold split has no rows; ValueError if that is every symbol.
    """
    if not steady(rule):
        raise ValueError("the rule's target has to stay known once it is")
    cut = F.lit(str(split)).cast("date")
    segment = F.when(F.col("ends") <= cut, "is").when(F.col("date") >= cut, "oos")
    shared = backtest.shared_intervals(_bars(bars, [rule]), start, segment)
    of_symbol = Window.partitionBy("symbol")
    shared = shared.withColumns({"opens": F.min("date").over(of_symbol), "closes": F.max("ends").over(of_symbol)}).filter((F.col("opens") < cut) & (cut < F.col("closes"))).drop("opens", "closes")
    backtest.require_rows(shared, "no history for the rule, or the split lies outside every symbol's window")
    by = ("symbol", "rule", "segment")
    return metrics.summarise(backtest.with_equity(backtest.fanned(shared, [rule], cost_bps), by), by)


def split_bounds(bars: DataFrame, start, settings: Settings = SETTINGS) -> DataFrame:
    """Least, greatest and clamped default split per symbol."""
    low = F.add_months(F.lit(str(start)).cast("date"), 12 * settings.split_min_years)
    last = bars.groupBy("symbol").agg(F.add_months(F.max("date"), -settings.split_min_oos_months).alias("most"))
    return last.select("symbol", low.alias("least"), "most", F.greatest(low, F.col("most")).alias("most_clamped"))
