"""Detection from saved states, in tables and in a stream's state store, against detection over all bars."""

import datetime
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import events, resume
from tidewatch.operators.resume import Fold
from tidewatch.settings import SETTINGS
from tidewatch.sources.bars import BAR_SCHEMA
from tidewatch.streaming import keyed

SMALL = replace(SETTINGS, sigma_window=10, z_threshold=2.0, gap_threshold=0.02, drawdown_threshold=0.05, rally_threshold=0.05, rally_window=8, merge_window=2)
DAY0 = datetime.date(2020, 1, 1)


def walk(seed, n, vol=0.015, places=1):
    rng = np.random.default_rng(seed)
    closes = np.round(100 * np.exp(np.cumsum(rng.normal(0.0004, vol, n))), places)
    opens = np.round(np.concatenate([[100], closes[:-1]]) * np.exp(rng.normal(0, 0.008, n)), places)
    return [(DAY0 + datetime.timedelta(days=k), float(o), float(c)) for k, (o, c) in enumerate(zip(opens, closes))]


def frame(spark, rows):
    return spark.createDataFrame([(s, d, o, max(o, c), min(o, c), c, c, 1.0, "test") for s, (d, o, c) in rows], BAR_SCHEMA)


def keys(rows):
    near = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(tuple((k, str(near(v))) for k, v in sorted(r.items())) for r in rows)


@pytest.mark.parametrize("seed,places", [(0, 1), (1, 1), (2, 0), (3, 6)])
def test_state_and_tail_equal_all_bars_at_every_cut(spark, seed, places):
    """A state saved and read back after every bar; what it tells after each equals detect over the bars so far."""
    bars = walk(seed, 100, 0.02, places)
    want = {}
    for r in events.detect(frame(spark, [(f"{k:03d}", b) for k in range(1, 101) for b in bars[:k]]), SMALL).collect():
        want.setdefault(int(r.symbol), []).append({k: v for k, v in r.asDict().items() if k != "symbol"})
    state, days, told = None, {}, []
    for k, bar in enumerate(bars, 1):
        fold = Fold(SMALL, state, days)
        fold.add(*bar)
        told += fold.close()
        assert keys(told + fold.open()) == keys(want.get(k, [])), k
        state, days = fold.state(), dict(fold.days)
    assert told


def dips(n):
    """Rising, with a dip of ten days every sixty."""
    noise = np.random.default_rng(9).normal(1, 0.001, n)
    level = [float(100 * 1.001**k * noise[k] * (1 - 0.08 * np.sin(np.pi * min(k % 60, 10) / 10))) for k in range(n)]
    return [(DAY0 + datetime.timedelta(days=k), x, x) for k, x in enumerate(level)]


def test_state_is_bounded_while_bars_grow():
    """Prices that keep recovering: nothing stays open for long, and the state doesn't follow the bars."""
    most, fold, told = 0, Fold(SMALL), 0
    for bar in dips(4000):
        fold.add(*bar)
        told += len(fold.close())
        s = fold.state()
        most = max(most, len(fold.days) + sum(len(s[x]) for x in ("returns", "lows", "recent", "waiting", "legs")))
    assert told > 60 and most < 300


def test_resumed_tables(spark):
    rows = [(f"s{k}", b) for k in range(6) for b in walk(k, 150)]
    bars = frame(spark, rows)
    cuts, states, told = ["2020-02-20", "2020-03-01", "2020-05-01", "2021-01-01"], None, []
    lo = "2000-01-01"
    for hi in cuts:
        part = bars.filter((F.col("date") >= lo) & (F.col("date") < hi))
        part = part.unionByName(bars.filter(F.col("date") == lo)).unionByName(bars.filter(F.col("date") < "2020-01-05"))  # late and repeated bars
        done = resume.resume(part.repartition(3), states, SMALL).cache()
        states, lo = resume.states_of(done), hi
        told += [r.asDict() for r in resume.episodes_of(done).collect() if r.status == "closed" or hi == cuts[-1]]
    assert keys(told) == keys(r.asDict() for r in events.detect(bars, SMALL).collect())
    quiet = resume.resume(bars.limit(0), states, SMALL)
    assert resume.states_of(quiet).count() == 6 and resume.episodes_of(quiet).filter("status = 'closed'").count() == 0
    assert resume.resume(bars.limit(0), None, SMALL).count() == 0


def test_stream_from_the_state_store(spark, tmp_path):
    """Several batches with restarts: closed episodes once, revisions told, and days that nothing needs leave the store."""
    rows = {"a": walk(0, 160), "b": dips(160)}
    src, days = str(tmp_path / "in"), [b[0] for b in rows["a"]]
    read = lambda: spark.readStream.schema(BAR_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    kept = []
    for lo, hi in ((0, 70), (70, 71), (71, 120), (120, 160)):
        part = [(s, b) for s in rows for b in rows[s] if days[lo] <= b[0] < days[hi - 1] + datetime.timedelta(days=1)]
        frame(spark, part[::-1]).coalesce(1).write.mode("append").parquet(src)
        told = keyed.run_available(spark, read(), str(tmp_path / "out"), str(tmp_path / "check"), SMALL)
        state = spark.read.format("statestore").option("path", str(tmp_path / "check")).option("stateVarName", "days").load()
        kept.append(state.filter("key.symbol = 'b'").count())
    want = events.detect(frame(spark, [(s, b) for s in rows for b in rows[s]]), SMALL).filter("status = 'closed'")
    assert keys(r.asDict() for r in told.collect()) == keys(r.asDict() for r in want.collect())
    assert max(kept) < 75, kept  # of 160 bars
    late = [("a", rows["a"][150]), ("a", (days[151], 1.0, 2.0))]
    frame(spark, late).coalesce(1).write.mode("append").parquet(src)
    told = keyed.run_available(spark, read(), str(tmp_path / "out"), str(tmp_path / "check"), SMALL)
    assert [(r.symbol, r.start_date) for r in told.filter("status = 'refused'").collect()] == [("a", days[151])]
