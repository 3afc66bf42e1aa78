"""The vendor's data source: filters that reach it, spans, and a stream whose offsets are days."""

import datetime
import os

from pyspark.sql import functions as F

from tidewatch.sources import vendor


def fetcher(log):
    def fetch(symbol, start, end):
        with open(log, "a") as out:
            out.write(f"{symbol} {start} {end}\n")
        a, b = (datetime.date.fromisoformat(x) if x else None for x in (start, end))
        days = [datetime.date(2024, 1, 1) + datetime.timedelta(days=k) for k in range(40)]
        return [(d, 1.0, 2.0, 0.5, 1.5, 1.5, float(len(symbol))) for d in days if (a is None or d >= a) and (b is None or d <= b)]

    return fetch


def asked(log):
    found = sorted(open(log).read().splitlines()) if os.path.exists(log) else []
    if found:
        os.remove(log)
    return found


def test_filters_reach_the_vendor(spark, tmp_path):
    log = str(tmp_path / "log")
    bars = vendor.fetch_bars(spark, fetcher(log), ["A", "BB", "CC"], "2024-01-01")
    some = bars.filter((F.col("symbol") == "BB") & (F.col("date") > F.lit("2024-01-10").cast("date")) & (F.col("date") <= F.lit("2024-01-15").cast("date")))
    assert sorted(str(r["date"]) for r in some.collect()) == [f"2024-01-{k}" for k in range(11, 16)] and asked(log) == ["BB 2024-01-11 2024-01-15"]
    assert bars.filter(F.col("symbol").isin("A", "CC")).count() == 80 and asked(log) == ["A 2024-01-01 None", "CC 2024-01-01 None"]
    assert bars.filter("symbol = 'ZZ'").count() == 0 and asked(log) == []
    assert bars.filter("symbol = 'A' AND date = DATE '2030-01-01'").count() == 0 and asked(log) == ["A 2030-01-01 2030-01-01"]
    assert bars.filter("volume > 1").count() == 80 and len(asked(log)) == 3


def test_spans_are_bounded():
    got = vendor.spans("A", "2000-01-01", "2000-01-10", 4)
    assert [(s.start, s.end) for s in got] == [("2000-01-01", "2000-01-04"), ("2000-01-05", "2000-01-08"), ("2000-01-09", "2000-01-10")]
    assert vendor.spans("A", "2000-01-02", "2000-01-01") == [] and len(vendor.spans("A", "2000-01-01", None)) == 1


def test_a_stream_that_restarts_fetches_no_day_twice(spark, tmp_path):
    log, clock, out = str(tmp_path / "log"), tmp_path / "clock", str(tmp_path / "out")
    for today in ("2024-01-05", "2024-01-05", "2024-01-09"):
        clock.write_text(today)
        bars = vendor.stream_bars(spark, fetcher(log), ["A", "BB"], "2024-01-02", lambda: open(str(clock)).read())
        bars.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert asked(log) == ["A 2024-01-02 2024-01-05", "A 2024-01-06 2024-01-09", "BB 2024-01-02 2024-01-05", "BB 2024-01-06 2024-01-09"]
    rows = spark.read.parquet(out)
    assert rows.count() == 16 == rows.select("symbol", "date").distinct().count()
