import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import events, macro, regimes, sessions, snapshots
from tidewatch.settings import SETTINGS

DD = [100, 120, 90, 130, 104]


def test_drawdown_legs_and_table(make_bars):
    legs = [(r.start_pos, r.end_pos, round(r.move, 10), r.recovery_pos) for r in events.drawdown_legs(make_bars(DD)).orderBy("start_pos").collect()]
    assert legs == [(1, 2, -0.25, 3), (3, 4, -0.2, None)]
    t = regimes.drawdown_table(make_bars(DD)).orderBy("rank").collect()
    assert [(round(r.depth, 10), r.days_underwater, r.recovery is None) for r in t] == [(-0.25, 2, False), (-0.2, 1, True)]
    assert [round(r.drawdown, 10) for r in regimes.drawdown(make_bars(DD)).orderBy("date").collect()] == [0, 0, -0.25, 0, -0.2]


def test_kpis(make_bars):
    k = regimes.kpis(make_bars(DD)).first()
    assert math.isclose(k.current_drawdown, 104 / 130 - 1) and math.isclose(k.distance_from_ath, 130 / 104 - 1) and math.isclose(k.ytd_return, 0.04)


def test_clusters_join_within_three_bars(spark):
    cols = "symbol string, kind string, start_pos long, end_pos long, move double, recovery_pos long, reach_pos long"
    leg = lambda p: ("X", "shock", p, p, 0.0, None, None)
    count = lambda a, b: events.clustered(spark.createDataFrame([leg(a), leg(b)], cols)).select("cluster").distinct().count()
    assert count(10, 13) == 1 and count(10, 14) == 2


def test_gap_is_strict(make_bars):
    f = events.features(make_bars([100, 100, 100], [100, 102, 101]))
    assert [r.start_pos for r in events.gap_legs(f).collect()] == [1]


def loop_model(closes, opens, s):
    """Clusters by plain loops: (start, end, kinds)."""
    n, legs = len(closes), []
    ret = [None] + [math.log(closes[i] / closes[i - 1]) for i in range(1, n)]
    for i in range(s.sigma_window + 1, n):
        sd = np.std(ret[i - s.sigma_window : i], ddof=1)
        if abs(ret[i] / sd) > s.z_threshold:
            legs.append((i, i, "shock"))
    legs += [(i, i, "gap") for i in range(1, n) if abs(opens[i] / closes[i - 1] - 1) > s.gap_threshold]
    peak = 0
    for i in range(1, n + 1):
        if i == n or closes[i] >= closes[peak]:
            low = min(range(peak, i), key=lambda j: (closes[j], j))
            if closes[low] / closes[peak] - 1 <= -s.drawdown_threshold:
                legs.append((peak, low, "drawdown"))
            peak = i
    spans = []
    for i in range(n):
        j = min(range(max(0, i - s.rally_window), i + 1), key=lambda x: (closes[x], x))
        if closes[i] / closes[j] - 1 >= s.rally_threshold:
            spans.append([j, i])
    merged = []
    for a, b in sorted(spans, key=lambda x: x[0]):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        low = min(range(a, b + 1), key=lambda x: (closes[x], x))
        legs.append((low, max(range(low, b + 1), key=lambda x: (closes[x], -x)), "rally"))
    out = []
    for a, b, kind in sorted(legs):
        if out and a - out[-1][1] <= s.merge_window:
            out[-1][1] = max(out[-1][1], b)
            out[-1][2].add(kind)
        else:
            out.append([a, b, {kind}])
    return [(a, b, ",".join(sorted(k))) for a, b, k in out]


WALK = replace(SETTINGS, sigma_window=10, z_threshold=2.0, gap_threshold=0.02, drawdown_threshold=0.05, rally_threshold=0.05, rally_window=8, merge_window=2)


def walk(seed, n=160):
    rng = np.random.default_rng(seed)
    closes = np.round(100 * np.exp(np.cumsum(rng.normal(0.0004, 0.015, n))), 1)
    return closes, np.round(closes * np.exp(rng.normal(0, 0.008, n)), 1)


def test_detection_matches_loops(make_bars):
    closes, opens = walk(0)
    got = events.detect(make_bars(closes, opens), WALK).join(make_bars(closes).select(F.col("date").alias("start_date")), "start_date").orderBy("start_date").collect()
    days = {r.date: i for i, r in enumerate(make_bars(closes).orderBy("date").collect())}
    assert [(days[r.start_date], days[r.end_date], r.triggers) for r in got] == loop_model(list(closes), list(opens), WALK)


def test_closed_episodes_survive_new_bars(make_bars):
    closes, opens = walk(1)
    key = lambda r: (r.episode_id, r.start_date, r.end_date, r.anchor_date, round(r.move_pct, 9), round(r.max_z, 9), r.search_from, r.search_to, r.recovery_date)
    whole = {key(r) for r in events.detect(make_bars(closes, opens), WALK).collect()}
    for cut in (60, 110):
        closed = {key(r) for r in events.detect(make_bars(closes[:cut], opens[:cut]), WALK).filter("status = 'closed'").collect()}
        assert closed <= whole


def test_tagging_window(spark):
    e = spark.createDataFrame([("X", "a", "2020-03-12", "2020-03-18"), ("X", "b", "2021-01-01", "2021-01-02")], "symbol string, episode_id string, f string, t string").selectExpr("symbol", "episode_id", "date(f) search_from", "date(t) search_to")
    c = spark.createDataFrame([("2020-03-11", "CPI", "release", True), ("2020-03-15", "FOMC", "unscheduled", False), ("2020-03-18", "FOMC", "meeting", True)], "d string, release string, release_type string, scheduled boolean").selectExpr("date(d) date", "release", "release_type", "scheduled")
    a, b = macro.tag(e, c).orderBy("episode_id").collect()
    assert (a.scheduled_releases, a.unscheduled_releases, a.catalyst) == (["FOMC 2020-03-18"], ["FOMC 2020-03-15"], "scheduled")
    assert (b.scheduled_releases, b.catalyst) == ([], "surprise")


def test_year_page(spark):
    html = "<p>January 6 Conference Call - 1993</p> February 2-3 Meeting - 1993 March 17-18 (cancelled) Meeting - 1993 May 3 (unscheduled) Meeting - 1993 July 1 Meeting - 1999"
    rows = macro.parse_year_pages(spark.createDataFrame([(html, 1993, "https://x")], "html string, year int, source_url string"), ("1993-05-03",)).orderBy("date").collect()
    assert [(str(r.date), r.release_type, r.scheduled) for r in rows] == [("1993-01-06", "unscheduled", False), ("1993-02-03", "meeting", True)]
    with pytest.raises(Exception, match="unknown month"):
        macro.parse_year_pages(spark.createDataFrame([("Foo 2 Meeting - 1993", 1993, "u")], "html string, year int, source_url string")).collect()


def test_current_page(spark):
    html = "x 2021 FOMC Meetings Jan/Feb 31-1 Statement: March 16-17* Statement August 22 (notation vote) Statement 2022 FOMC Meetings October 27-28 December 8-9* * note, Released February 18, 2026"
    rows = macro.parse_current_page(spark.createDataFrame([(html, "https://x")], "html string, source_url string")).orderBy("date").collect()
    assert [str(r.date) for r in rows] == ["2021-02-01", "2021-03-17", "2022-10-28", "2022-12-09"]


def test_release_dates_refuse_pages(spark):
    j = '{"count": 2, "release_dates": [{"release_id": 10, "date": "2020-01-01"}]}'
    with pytest.raises(Exception, match="cut into pages"):
        macro.parse_release_dates(spark.createDataFrame([(j, "CPI", "release")], "json string, release string, release_type string")).collect()


def test_merge_guards_the_past(spark):
    c = lambda rows: spark.createDataFrame(rows, "d string, release string, release_type string, scheduled boolean, source_url string").selectExpr("date(d) date", "release", "release_type", "scheduled", "source_url")
    old = c([("2020-01-01", "CPI", "release", True, "u")])
    with pytest.raises(ValueError):
        macro.merge(old, c([("2020-01-02", "CPI", "release", True, "u")]), "2021-01-01")
    emergency = c([("2020-01-01", "CPI", "release", True, "u"), ("2020-03-03", "FOMC", "unscheduled", False, "u")])
    assert macro.merge(old, emergency, "2021-01-01").count() == 2


def test_holidays_of_2024(spark):
    got = [str(r.date) for r in sessions.holidays(spark, "2024-01-01", "2024-12-31").orderBy("date").collect()]
    assert got == ["2024-01-01", "2024-01-15", "2024-02-19", "2024-03-29", "2024-05-27", "2024-06-19", "2024-07-04", "2024-09-02", "2024-11-28", "2024-12-25"]
    assert sessions.business_days(spark, "2024-01-01", "2024-12-31").count() == 262


def test_snapshot_gate(spark, make_bars):
    old = make_bars([100.0] * 5, start="2024-01-02")
    days = old.select("date")
    snapshots.validate(old, old, days)
    with pytest.raises(ValueError, match="rewrite"):
        snapshots.validate(old, make_bars([100, 100, 101, 100, 100], start="2024-01-02"), days)
    with pytest.raises(ValueError, match="rows"):
        snapshots.validate(old, make_bars([100.0] * 4, start="2024-01-02"), days)
