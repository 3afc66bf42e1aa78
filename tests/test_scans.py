"""Running values in two levels and joins with intervals, against plain loops."""

import datetime

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators.indicators import MASpec, add_averages, ema_block
from tidewatch.operators.ranges import interval_places, point_places
from tidewatch.operators.scans import Scan, in_chunks, lagged, running

DAY0 = datetime.date(1990, 1, 1)


def series(spark, values, symbol="a", step=1):
    return spark.createDataFrame([(symbol, DAY0 + datetime.timedelta(days=k * step), v) for k, v in enumerate(values)], "symbol string, date date, close double")


def test_running_values_of_one_symbol_in_many_tasks(spark):
    rng = np.random.default_rng(2)
    xs = np.round(100 * np.exp(np.cumsum(rng.normal(0, 0.01, 3000))), 3).tolist()
    gaps = [None if rng.random() < 0.05 else x for x in xs]
    both = series(spark, xs, "a", 2).unionByName(series(spark, gaps, "b")).unionByName(series(spark, [None, None, 5.0], "c", 400))
    kinds = {k: Scan(k, "close") for k in ("sum", "count", "max", "min")} | {"product": Scan("product", "ratio"), "ema10": Scan("ema", "close", 10), "ema200": Scan("ema", "close", 200)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a few rows would all go to one task
    out = running(both.withColumn("ratio", F.col("close") / 100), kinds).withColumn("task", F.spark_partition_id()).cache()
    assert out.filter("symbol = 'a'").select("task").distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for symbol, want in (("a", xs), ("b", gaps), ("c", [None, None, 5.0])):
        rows = out.filter(F.col("symbol") == symbol).orderBy("date").collect()
        assert len(rows) == len(want)
        known, product, ema = [], 1.0, {10: None, 200: None}
        for r, x in zip(rows, want):
            if x is not None:
                known.append(x)
                product *= x / 100
                for n in ema:
                    ema[n] = x if ema[n] is None else ema[n] + 2 / (n + 1) * (x - ema[n])
            assert r["count"] == len(known) and r["max"] == max(known, default=None) and r["min"] == min(known, default=None)
            assert r["product"] == pytest.approx(product, rel=1e-9) and (r["sum"] is None) == (not known)
            assert not known or r["sum"] == pytest.approx(sum(known), rel=1e-12)
            for n in ema:
                assert r[f"ema{n}"] is None if len(known) < n else r[f"ema{n}"] == pytest.approx(ema[n], rel=1e-11)
    with pytest.raises(ValueError):
        Scan("median", "close")
    with pytest.raises(ValueError):
        Scan("ema", "close")


def test_moving_values_over_the_ends_of_chunks(spark):
    xs = [float(k % 37) for k in range(2600)]
    b = series(spark, xs)
    got = in_chunks(b, 19, lambda d: add_averages(d, [MASpec("sma", 20)])).orderBy("date").collect()
    assert [r.symbol for r in got] == ["a"] * 2600
    assert [r.sma20 for r in got] == [None] * 19 + [pytest.approx(np.mean(xs[k - 19 : k + 1])) for k in range(19, 2600)]
    w = Window.partitionBy("symbol").orderBy("date")
    assert [r.was for r in lagged(b, {"was": F.lag("close", 3).over(w)}, 3).orderBy("date").collect()] == [None] * 3 + xs[:-3]


@pytest.mark.parametrize("unit", [1e-13, 1.0, 1e17])
def test_averages_of_prices_of_any_size(spark, unit):
    xs = [unit * (3 + k % 7) for k in range(60)]
    got = add_averages(series(spark, xs), [MASpec("sma", 2), MASpec("ema", 2), MASpec("ema", 1)]).orderBy("date").collect()
    ema = xs[0]
    for k, r in enumerate(got):
        ema = xs[0] if k == 0 else ema + 2 / 3 * (xs[k] - ema)
        assert r.ema1 == xs[k]
        if k:
            assert r.sma2 == pytest.approx((xs[k] + xs[k - 1]) / 2, rel=1e-12) and r.ema2 == pytest.approx(ema, rel=1e-12)


def test_exponential_average_over_many_blocks(spark):
    n, rng = 2, np.random.default_rng(5)
    xs = np.round(rng.uniform(50, 150, 3 * ema_block(n) + 5), 2).tolist()
    xs[7] = xs[ema_block(n)] = None
    got = add_averages(series(spark, xs), [MASpec("ema", n)]).orderBy("date").collect()
    ema, known = None, 0
    for x, r in zip(xs, got):
        if x is not None:
            ema, known = x if ema is None else ema + 2 / (n + 1) * (x - ema), known + 1
        assert r.ema2 is None if known < n else r.ema2 == pytest.approx(ema, rel=1e-11)
    plan = add_averages(series(spark, [1.0]), [MASpec("ema", 5)])._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Arrow" not in plan


def test_points_meet_the_intervals_that_hold_them(spark):
    rng = np.random.default_rng(3)
    day = lambda k: DAY0 + datetime.timedelta(days=int(k))
    spans = [(k, a, a + int(n)) for k, (a, n) in enumerate(zip(rng.integers(-400, 2000, 120), [0, 1, 2, 3, 7, 8, 9, 63, 64, 65, 1000, -1] * 10))] + [(500, -40000, 60000)]
    points = [(k, int(p)) for k, p in enumerate(rng.integers(-500, 3200, 300))]
    s = spark.createDataFrame([(k, day(a), day(b)) for k, a, b in spans] + [(900, None, None)], "span int, a date, b date").withColumn("places", interval_places(F.col("a"), F.col("b")))
    p = spark.createDataFrame([(k, day(x)) for k, x in points], "point int, at date").withColumn("places", point_places(F.col("at")))
    assert s.filter("span < 500").agg(F.max(F.size("places"))).first()[0] == 2
    met = s.select("span", "a", "b", F.explode("places").alias("x")).join(p.select("point", "at", F.explode("places").alias("x")), "x").filter("at BETWEEN a AND b")
    got = sorted((r.span, r.point) for r in met.collect())
    assert got == sorted((i, k) for i, a, b in spans for k, x in points if a <= x <= b)
