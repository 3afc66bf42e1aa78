import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import backtest, grid, metrics
from tidewatch.operators.indicators import MASpec, add_averages, ema_fold
from tidewatch.operators.signals import Both, MACrossover, Strategy, TrendFilter, both, crossings, crossover, targets
from tidewatch.sources import bars as prices

TINY = [100, 110, 99, 99, 120, 132]


def with_target(bars, values):
    rows = [(r.symbol, "t", r.date, r.open, r.close, None if v is None else float(v)) for r, v in zip(bars.orderBy("date").collect(), values)]
    return bars.sparkSession.createDataFrame(rows, "symbol string, rule string, date date, open double, close double, target double")


def test_hand_computed_backtest(make_bars):
    t = with_target(make_bars(TINY), [1, 0, 0, 1, 1, 1])
    r = backtest.run(t).orderBy("date").collect()
    assert math.isclose(r[-1].equity, 0.9 * 1.1) and math.isclose(r[-1].benchmark, 132 / 110)
    got = [(x.side, x.price) for x in backtest.trades(backtest.run(t)).orderBy("date").collect()]
    assert got == [("buy", 110), ("sell", 99), ("buy", 120)]
    days = [x.date for x in backtest.curve(backtest.run(t)).orderBy("date").collect()]
    assert days == sorted(x.date for x in t.collect())[1:]


def test_costs(make_bars):
    r = backtest.run(with_target(make_bars(TINY), [1, 0, 0, 1, 1, 1]), 10).orderBy("date").collect()
    assert math.isclose(r[-1].equity, (1 - 0.1 - 0.001) * (1 - 0.001) * (1 + 0.1 - 0.001))


def test_always_long_is_buy_and_hold_and_cash_is_flat(make_bars):
    long = backtest.run(with_target(make_bars(TINY), [1] * 6)).orderBy("date").collect()
    cash = backtest.run(with_target(make_bars(TINY), [0] * 6)).orderBy("date").collect()
    assert all(math.isclose(x.equity, x.benchmark) for x in long) and all(x.equity == 1 for x in cash)


def test_metrics_by_hand(make_bars):
    s = metrics.summarise(backtest.run(with_target(make_bars(TINY), [1] * 6))).first()
    ret = np.array([99 / 110, 1, 120 / 99, 132 / 120]) - 1
    assert math.isclose(s.total_return, 132 / 110 - 1) and math.isclose(s.max_drawdown, 99 / 110 - 1)
    assert math.isclose(s.sharpe, ret.mean() / ret.std(ddof=1) * math.sqrt(252))
    dd = math.sqrt((np.minimum(ret, 0) ** 2).mean()) * math.sqrt(252)
    assert math.isclose(s.sortino, ret.mean() * 252 / dd) and s.fills == 1 and s.time_in_market == 1


def test_undefined_metrics_are_null(make_bars):
    s = metrics.summarise(backtest.run(with_target(make_bars([100, 100, 100, 100]), [1] * 4))).first()
    assert s.sharpe is None and s.sortino is None and s.calmar is None


def test_averages_match_pandas(spark, make_bars):
    rng = np.random.default_rng(7)
    closes = 100 * np.exp(np.cumsum(rng.normal(0.0003, 0.011, 300)))
    specs = [MASpec("sma", 20), MASpec("ema", 10), MASpec("ema", 50)]
    got = add_averages(make_bars(closes), specs).withColumn("fold", ema_fold(10)).orderBy("date").toPandas()
    s = pd.Series(closes)
    for label, want in (("sma20", s.rolling(20).mean()), ("ema10", s.ewm(span=10, adjust=False, min_periods=10).mean()), ("ema50", s.ewm(span=50, adjust=False, min_periods=50).mean()), ("fold", s.ewm(span=10, adjust=False, min_periods=10).mean())):
        np.testing.assert_allclose(got[label].astype(float), want, rtol=1e-9)


def test_crossover_and_crossings(spark):
    d = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (4.0, 3.0), (3.0, 3.0), (1.0, 3.0), (None, 3.0)], "a double, b double")
    assert [r[0] for r in d.select(crossover(F.col("a"), F.col("b"))).collect()] == [0, 0, 1, 0, 0, None]
    e = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0), (0.0, None), (None, 1.0)], "a double, b double")
    assert [r[0] for r in e.select(both(F.col("a"), F.col("b"))).collect()] == [1, 0, None, None]


def test_crossing_rows(make_bars):
    t = with_target(make_bars(TINY), [None, 0, 1, 1, 0, 0])
    assert [r.crossing for r in crossings(t).orderBy("date").collect()] == [1, -1]


def test_no_look_ahead(make_bars):
    rng = np.random.default_rng(1)
    closes = 100 + np.cumsum(rng.normal(0, 1, 60))
    rule = MACrossover(MASpec("sma", 3), MASpec("ema", 8), 10)
    a = {r.date: r.target for r in targets(make_bars(closes), [rule]).collect()}
    changed = closes.copy()
    changed[40:] *= 2
    b = {r.date: r.target for r in targets(make_bars(changed), [rule]).collect()}
    assert all(a[x] == b[x] for x in sorted(a)[:40])


def test_grid_shares_one_window_and_heatmap_agrees(make_bars):
    rng = np.random.default_rng(3)
    closes = 100 * np.exp(np.cumsum(rng.normal(0.0003, 0.011, 220)))
    b = make_bars(closes, closes * np.exp(rng.normal(0, 0.003, 220))).persist()
    rules = [MACrossover(MASpec("sma", s), MASpec("sma", n)) for s in (3, 5) for n in (20, 60)]
    g = grid.run_grid(b, rules, 5.0).collect()
    assert len({round(r.bh_total_return, 12) for r in g}) == 1
    assert [r.excess_total_return for r in g] == sorted((r.excess_total_return for r in g), reverse=True)
    cells = {(r.short, r.long): r.excess for r in grid.heatmap(b, rules, 5.0).collect()}
    for r in g:
        s, n = (int(x.removeprefix("sma")) for x in r.rule.split("__"))
        assert math.isclose(cells[s, n], r.excess_total_return, abs_tol=1e-12)
    assert metrics.count_beating(grid.run_grid(b, rules, 5.0)).first().rules == 4


def test_split_is_judged_for_each_symbol(make_bars):
    rng = np.random.default_rng(4)
    walk = lambda n: 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    old, young = make_bars(walk(120), symbol="OLD"), make_bars(walk(30), start="2024-05-01", symbol="YOUNG")
    rule = MACrossover(MASpec("sma", 2), MASpec("sma", 5))
    got = grid.in_out_of_sample(old.unionByName(young), rule, "2024-03-15", None, 5.0)
    assert {(r.symbol, r.segment) for r in got.collect()} == {("OLD", "is"), ("OLD", "oos")}
    for r in got.collect():
        part = grid.evaluate(old, rule, 5.0, end="2024-03-15") if r.segment == "is" else grid.evaluate(old, rule, 5.0, "2024-03-15")
        alone = metrics.summarise(part).first()
        assert all(math.isclose(r[c], alone[c], rel_tol=1e-9, abs_tol=1e-12) for c in ("total_return", "sharpe", "max_drawdown", "bh_total_return", "time_in_market")) and r.fills == alone.fills


def test_rules_of_users_take_the_general_path(make_bars):
    class Odd:
        """Unknown on every fifth bar, and with a sign in its name that others split at."""

        name = "a|b"

        def needs(self):
            return [MASpec("sma", 3)]

        def target(self):
            return F.when(F.dayofmonth("date") % 5 != 0, crossover(F.col("close"), F.col("sma3")))

    rng = np.random.default_rng(9)
    b = make_bars(100 * np.exp(np.cumsum(rng.normal(0, 0.02, 60))))
    rule = MACrossover(MASpec("sma", 2), MASpec("sma", 5))
    assert {r.rule for r in grid.run_grid(b, [Odd(), rule], 5.0).collect()} == {"a|b", rule.name}
    fast = grid.run_grid(b, [rule], 5.0).first()
    slow = metrics.summarise(backtest.compounded(backtest.intervals(targets(b, [rule])).join(grid.common_window(targets(b, [rule])), "symbol").filter("date >= opens").drop("opens", "closes"), 5.0)).first()
    assert all(math.isclose(fast[c], slow[c], rel_tol=1e-12, abs_tol=1e-12) for c in ("total_return", "sharpe", "sortino", "calmar", "excess_cagr"))


def test_errors(make_bars):
    b = make_bars(TINY)
    with pytest.raises(ValueError):
        prices.on_basis(b, "raw")
    with pytest.raises(ValueError):
        MASpec.from_label("wma5")
    with pytest.raises(ValueError):
        backtest.require_rows(grid.evaluate(b, MACrossover(MASpec("sma", 2), MASpec("sma", 50))))
    with pytest.raises(ValueError):
        grid.in_out_of_sample(b, MACrossover(MASpec("sma", 1), MASpec("sma", 2)), "2030-01-01")


def test_names_and_plug_in(make_bars):
    rule = Both(MACrossover(MASpec("ema", 10), MASpec("sma", 200), 200), TrendFilter(50))
    assert rule.name == "ema10__sma200__trend200__and__close__sma50" and isinstance(rule, Strategy)
    assert len(grid.default_rules()) == 24 and len(grid.heatmap_rules()) == 192

    class AlwaysLong:
        name = "long"

        def needs(self):
            return []

        def target(self):
            return F.lit(1.0)

    assert {r.target for r in targets(make_bars(TINY), [AlwaysLong()]).collect()} == {1.0}


def test_normalise_and_incomplete(spark):
    rows = [("X", "2024-01-02", 1.0, None, 1), ("X", "2024-01-02", 2.0, 2.0, 2), ("X", "2024-01-03", 3.0, 3.0, 3), ("X", "2024-01-03", 3.0, None, 4)]
    raw = spark.createDataFrame(rows, "symbol string, date string, open double, close double, arrival int").selectExpr("*", "open high", "open low", "open adj_close", "1.0D volume")
    n = prices.normalise(raw)
    assert [(str(r.date), r.close) for r in n.collect()] == [("2024-01-02", 2.0)]
    assert prices.drop_incomplete(n, "2024-01-02 20:00:00", "16:30").count() == 0
    assert prices.drop_incomplete(n, "2024-01-02 22:00:00", "16:30").count() == 1
