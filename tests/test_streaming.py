import datetime
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from tidewatch.operators.events import detect
from tidewatch.settings import SETTINGS
from tidewatch.streaming import episodes as stream


def test_stream_tells_each_closed_episode_once(spark, tmp_path, make_bars):
    s = replace(SETTINGS, sigma_window=10, z_threshold=2.0, gap_threshold=0.02, rally_threshold=0.05, rally_window=8, merge_window=2)
    rng = np.random.default_rng(4)
    bars = make_bars(np.round(100 * np.exp(np.cumsum(rng.normal(0, 0.015, 90))), 1))
    days = [r.date for r in bars.select("date").orderBy("date").collect()]
    src = str(tmp_path / "in")
    for lo, hi in ((0, 50), (45, 90)):
        bars.filter(bars.date.between(days[lo], days[hi - 1])).coalesce(1).write.mode("append").parquet(src)
    told = stream.run_available(spark, src, str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "check"), s)
    got = sorted(r.episode_id for r in told.collect())
    want = sorted(r.episode_id for r in detect(bars, s).filter("status = 'closed'").collect())
    assert got == want and len(got) == len(set(got))


def test_a_batch_touches_its_own_symbols_only(spark, tmp_path, make_bars):
    s = replace(SETTINGS, sigma_window=10, z_threshold=2.0, gap_threshold=0.02, rally_threshold=0.05, rally_window=8, merge_window=2)
    rng = np.random.default_rng(6)
    one = lambda symbol, lo, hi, seed: make_bars(np.round(100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.02, 80))), 1), symbol=symbol).orderBy("date").limit(hi).orderBy(F.desc("date")).limit(hi - lo)
    write = stream.EpisodeWriter(str(tmp_path / "state"), str(tmp_path / "out"), s, buckets=16)
    write(one("A", 0, 60, 1).unionByName(one("B", 0, 60, 2)), 0)
    stamp = lambda: {p.name: p.stat().st_mtime_ns for p in (tmp_path / "state/bars").iterdir()}
    before = stamp()
    write(one("A", 50, 80, 1), 1)
    after = stamp()
    assert len(before) == 2 and sum(before[k] != after[k] for k in before) == 1 and rng is not None
    write(one("A", 50, 80, 1), 1)  # the same batch again
    told = [(r.symbol, r.episode_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    want = detect(one("A", 0, 80, 1), s).unionByName(detect(one("B", 0, 60, 2), s)).filter("status = 'closed'")
    assert sorted(told) == sorted((r.symbol, r.episode_id) for r in want.collect())


def test_partial_bars_wait(spark, tmp_path, make_bars):
    bars = make_bars([1.0, 2.0, 3.0], start="2024-01-02")
    write = stream.EpisodeWriter(str(tmp_path / "state"), str(tmp_path / "out"), now=lambda: "2024-01-04 20:00:00", buckets=4)
    write(bars, 0)
    kept = lambda: {str(r.date): r.close for r in write.bars(spark, range(4)).collect()}
    assert kept() == {"2024-01-02": 1.0, "2024-01-03": 2.0}
    stream.EpisodeWriter(str(tmp_path / "state"), str(tmp_path / "out"), now=lambda: "2024-01-04 22:00:00", buckets=4)(bars, 1)
    assert kept()["2024-01-04"] == 3.0


def test_rewrites_are_refused_and_ties_have_an_order(spark, make_bars):
    old, new = make_bars([10.0, 20.0]), make_bars([10.0005, 21.0, 30.0])
    assert [r.date for r in stream.refused(old, new, 0.0001).collect()] == [datetime.date(2024, 1, 2)]
    twice = new.unionByName(new.withColumn("close", F.col("close") + 1).filter("date > '2024-01-02'"))
    for d in (twice, twice.orderBy(F.desc("close")).repartition(3)):
        got = {str(r.date): r.close for r in stream.merge_bars(old, d, 0.0001).collect()}
        assert got == {"2024-01-01": 10.0005, "2024-01-02": 20.0, "2024-01-03": 30.0}


def test_weeks_of_a_stream(spark, tmp_path, make_bars):
    src = str(tmp_path / "in")
    make_bars([float(k) for k in range(1, 16)], start="2024-01-01").coalesce(1).write.parquet(src)
    make_bars([99.0], start="2024-03-01").coalesce(1).write.mode("append").parquet(src)
    q = stream.weekly(stream.bar_stream(spark, src, 2)).writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {str(r.week): (r.high, r.low, r.volume) for r in spark.table("weeks").collect()}
    assert got["2024-01-01"] == (5.0, 1.0, 5.0) and got["2024-01-08"] == (10.0, 6.0, 5.0) and got["2024-02-26"][0] == 99.0
