"""Regimes, detection, sessions, snapshots and the macro calendar."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import events, macro, regimes, reports, resume, sessions, snapshots
from ..operators.enrichment import bad_ids, narrowed, null_explanations, read_overrides, to_records, write_overrides
from ..settings import SETTINGS
from ..sources import files
from .base import bars, bars_sql, fresh, rounded, table, with_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
S = SETTINGS


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


B = bars_sql()
B8 = bars_sql(8)
DD = "dd AS (SELECT symbol, date, close, row_number() OVER w - 1 pos, count(*) OVER (PARTITION BY symbol) n, close / max(close) OVER w - 1 drawdown, max(close) OVER w pk FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING))"
SPANS = """i0 AS (SELECT *, pos - row_number() OVER (PARTITION BY symbol, th ORDER BY pos) island FROM dd, (VALUES (-0.05), (-0.10), (-0.20)) v(th) WHERE drawdown <= CAST(th AS DOUBLE)),
sp AS (SELECT symbol, CAST(th AS DOUBLE) threshold, min(date) start, max(date) AS "end" FROM i0 GROUP BY symbol, th, island)"""
UNDER = """u0 AS (SELECT *, sum(CASE WHEN close = pk THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY pos ROWS UNBOUNDED PRECEDING) grp FROM dd),
u1 AS (SELECT symbol, grp, min(pos) peak_pos, min(date) peak, max(close) top, min({'c': close, 'p': pos, 'd': date}) low, max(n) n FROM u0 GROUP BY 1, 2),
u2 AS (SELECT *, lead(peak_pos) OVER w recovery_pos, lead(peak) OVER w recovery FROM u1 WINDOW w AS (PARTITION BY symbol ORDER BY grp)),
uw AS (SELECT symbol, peak_pos, peak, low.p trough_pos, low.d trough, recovery_pos, recovery, low.c / top - 1 depth, n FROM u2 WHERE low.c < top)"""


@query("w20_regime_spans", with_sql(B8, DD, SPANS, select="SELECT * FROM sp"))
def regime_spans(spark, d):
    return regimes.all_spans(bars(spark, d, 8), S.drawdown_regimes)


@query("j14_spans_in_window", with_sql(B, DD, SPANS, select="SELECT symbol, threshold, greatest(start, DATE '1996-02-01') start, least(\"end\", DATE '1998-06-30') AS \"end\" FROM sp WHERE \"end\" >= DATE '1996-02-01' AND start <= DATE '1998-06-30'"))
def clipped(spark, d):
    return regimes.clip_spans(regimes.all_spans(bars(spark, d), S.drawdown_regimes), "1996-02-01", "1998-06-30")


@query("w21_drawdown_table", with_sql(B8, DD, UNDER, "rk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY depth, peak) rank FROM uw)", select="SELECT symbol, CAST(rank AS INTEGER) rank, peak, trough, recovery, round(depth, 8) depth, CAST(coalesce(recovery_pos, n - 1) - peak_pos AS BIGINT) days_underwater FROM rk WHERE rank <= 10"))
def drawdown_table(spark, d):
    return rounded(regimes.drawdown_table(bars(spark, d, 8), S.top_drawdowns))


@query("a11_kpis", with_sql(B8, """kx AS (SELECT *, ln(close / lag(close) OVER w) lr, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) rb, year(max(date) OVER (PARTITION BY symbol)) yy FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))""", select="""SELECT symbol, round(arg_max(close, date) / coalesce(arg_max(close, date) FILTER (WHERE year(date) = yy - 1), arg_min(close, date) FILTER (WHERE year(date) = yy)) - 1, 8) ytd_return,
round(arg_max(close, date) / max(close) - 1, 8) current_drawdown, round(max(close) / arg_max(close, date) - 1, 8) distance_from_ath, round(stddev_samp(lr) FILTER (WHERE rb <= 20) * sqrt(252.0), 8) realised_vol,
min(date) FILTER (WHERE close = mx) ath_date FROM (SELECT *, max(close) OVER (PARTITION BY symbol) mx FROM kx) GROUP BY 1"""))
def kpis(spark, d):
    return rounded(regimes.kpis(bars(spark, d, 8), S.vol_window))


FEATURES = """f0 AS (SELECT symbol, date, open, close, row_number() OVER w - 1 pos, count(*) OVER (PARTITION BY symbol) n, lag(close) OVER w prev FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
f1 AS (SELECT *, ln(close / prev) ret, open / prev - 1 gap FROM f0),
f2 AS (SELECT *, CASE WHEN count(ret) OVER w = 60 THEN stddev_samp(ret) OVER w END sd FROM f1 WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, CASE WHEN sd > 0 THEN ret / sd END z FROM f2)"""
RALLY = """r0 AS (SELECT symbol, pos e, close, min({'c': close, 'p': pos}) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) low FROM f),
rc AS (SELECT symbol, low.p s, e FROM r0 WHERE close / low.c - 1 >= 0.08),
r1 AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY symbol ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END nw FROM rc),
r2 AS (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY s, e ROWS UNBOUNDED PRECEDING) span FROM r1),
r3 AS (SELECT symbol, span, min(s) s, max(e) e FROM r2 GROUP BY 1, 2),
r4 AS (SELECT r3.*, f.pos, f.close, min({'c': f.close, 'p': f.pos}) OVER (PARTITION BY r3.symbol, span) low FROM r3 JOIN f ON f.symbol = r3.symbol AND f.pos BETWEEN s AND e),
rl AS (SELECT symbol, span, e, max({'c': close, 'b': -pos}) high, max(low) low FROM r4 WHERE pos >= low.p GROUP BY 1, 2, 3)"""
LEGS = """legs AS (SELECT symbol, 'shock' kind, pos start_pos, pos end_pos, ret AS move, NULL::BIGINT recovery_pos, NULL::BIGINT reach_pos FROM f WHERE abs(z) > 2.5
UNION ALL SELECT symbol, 'gap', pos, pos, ret, NULL, NULL FROM f WHERE abs(gap) > 0.015
UNION ALL SELECT symbol, 'drawdown', peak_pos, trough_pos, depth, recovery_pos, NULL FROM uw WHERE depth <= -0.05
UNION ALL SELECT symbol, 'rally', low.p, -high.b, high.c / low.c - 1, NULL, e FROM rl),
c0 AS (SELECT *, CASE WHEN start_pos <= max(end_pos) OVER (PARTITION BY symbol ORDER BY start_pos, end_pos, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 THEN 0 ELSE 1 END nw FROM legs),
cl AS (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY start_pos, end_pos, kind ROWS UNBOUNDED PRECEDING) cluster FROM c0)"""
FRONTIER = "fr AS (SELECT symbol, least(max(n) - 30, CASE WHEN arg_max(close, pos) < max(top) THEN max(CASE WHEN close = top THEN pos END) ELSE max(n) END) frontier, max(n) n FROM (SELECT *, max(close) OVER (PARTITION BY symbol) top FROM f) GROUP BY 1)"
DETECT = """g AS (SELECT symbol, cluster, min(start_pos) s, max(end_pos) e, max(coalesce(reach_pos, end_pos)) reach, min(CASE kind WHEN 'drawdown' THEN 1 WHEN 'rally' THEN 2 WHEN 'shock' THEN 3 ELSE 4 END) tr,
 array_to_string(list_sort(list_distinct(list(kind))), ',') triggers, min(CASE WHEN kind = 'drawdown' THEN move END) worst, max(CASE WHEN kind = 'rally' THEN move END) best,
 count(*) FILTER (WHERE kind = 'drawdown' AND recovery_pos IS NULL) un, max(CASE WHEN kind = 'drawdown' THEN recovery_pos END) rec FROM cl GROUP BY 1, 2),
h AS (SELECT g.symbol, g.cluster, arg_max(f.pos, {'a': abs(ret), 'b': -f.pos}) FILTER (WHERE ret IS NOT NULL) anchor, coalesce(max(abs(z)), 0.0) max_z,
 arg_min(f.pos, {'a': ret, 'b': f.pos}) FILTER (WHERE ret IS NOT NULL) dn, arg_max(f.pos, {'a': ret, 'b': -f.pos}) FILTER (WHERE ret IS NOT NULL) up
 FROM g JOIN f ON f.symbol = g.symbol AND f.pos BETWEEN s AND e GROUP BY 1, 2),
p AS (SELECT g.*, h.anchor, h.max_z, fr.frontier, fr.n, CASE WHEN tr = 1 THEN dn WHEN tr = 2 THEN up END st, ['drawdown', 'rally', 'shock', 'gap'][tr] trg FROM g JOIN h ON h.symbol = g.symbol AND h.cluster = g.cluster JOIN fr ON fr.symbol = g.symbol),
q AS (SELECT *, least(greatest(coalesce(st - 2, s - 2), 0), n - 1) a, least(greatest(coalesce(st + 2, e + 1), 0), n - 1) b FROM p),
ask AS (SELECT symbol, cluster, unnest([{'k': 'fa', 'p': anchor}, {'k': 'fs', 'p': s}, {'k': 'fe', 'p': e}, {'k': 'fp', 'p': greatest(s - 1, 0)}, {'k': 'f1', 'p': a}, {'k': 'f2', 'p': b}, {'k': 'fx', 'p': rec}]) u FROM q),
an AS (SELECT ask.symbol, ask.cluster, max(CASE WHEN u.k = 'fa' THEN date END) fa, max(CASE WHEN u.k = 'fa' THEN ret END) fr, max(CASE WHEN u.k = 'fs' THEN date END) fs, max(CASE WHEN u.k = 'fe' THEN date END) fe, max(CASE WHEN u.k = 'fe' THEN close END) ce,
 max(CASE WHEN u.k = 'fp' THEN close END) cp, max(CASE WHEN u.k = 'f1' THEN date END) f1, max(CASE WHEN u.k = 'f2' THEN date END) f2, max(CASE WHEN u.k = 'fx' THEN date END) fx FROM ask JOIN f ON f.symbol = ask.symbol AND f.pos = u.p GROUP BY 1, 2),
ep AS (SELECT q.symbol, strftime(fa, '%Y-%m-%d') || '_' || trg episode_id, fs start_date, fe end_date, fa anchor_date,
 CASE WHEN tr = 1 THEN 'down' WHEN tr = 2 THEN 'up' WHEN fr < 0 THEN 'down' ELSE 'up' END direction, trg AS trigger, triggers,
 CASE WHEN tr = 1 THEN worst WHEN tr = 2 THEN best ELSE ce / cp - 1 END move_pct, max_z, f1 search_from, f2 search_to, CASE WHEN un = 0 THEN fx END recovery_date,
 CASE WHEN reach + 3 < frontier AND un = 0 THEN 'closed' ELSE 'open' END status
 FROM q JOIN an ON an.symbol = q.symbol AND an.cluster = q.cluster)"""


def detect_sql(symbols: int) -> tuple:
    return (bars_sql(symbols), FEATURES, DD, UNDER, RALLY, LEGS, FRONTIER, DETECT)


EP_SELECT = "symbol, episode_id, start_date, end_date, anchor_date, direction, trigger, triggers, round(move_pct, 6) move_pct, round(max_z, 6) max_z, round(max_z + abs(move_pct) / 0.05, 6) severity, search_from, search_to, recovery_date, status, 1 detector_version"


@query("w9_shock_zscores", with_sql(B8, FEATURES, select="SELECT symbol, date, round(ret, 8) ret, round(z, 6) z, round(gap, 8) gap FROM f"))
def zscores(spark, d):
    f = events.features(bars(spark, d, 8))
    return f.select("symbol", "date", F.round("ret", 8).alias("ret"), F.round("z", 6).alias("z"), F.round("gap", 8).alias("gap"))


@query("w10_shock_days", with_sql(B8, FEATURES, select="SELECT symbol, pos, date FROM f WHERE abs(z) > 2.5"))
def shocks(spark, d):
    f = events.features(bars(spark, d, 8))
    return events.shock_legs(f).select("symbol", F.col("start_pos").alias("pos")).join(f.select("symbol", "pos", "date"), ["symbol", "pos"])


@query("w11_gap_days", with_sql(B8, FEATURES, select="SELECT symbol, pos AS start_pos, round(ret, 8) AS move FROM f WHERE abs(gap) > 0.015"))
def gaps(spark, d):
    return rounded(events.gap_legs(events.features(bars(spark, d, 8))).select("symbol", "start_pos", "move"))


@query("w12_drawdown_legs", with_sql(B8, DD, UNDER, select="SELECT symbol, peak_pos start_pos, trough_pos end_pos, round(depth, 8) AS move, recovery_pos FROM uw WHERE depth <= -0.05"))
def dd_legs(spark, d):
    return rounded(events.drawdown_legs(bars(spark, d, 8)).select("symbol", "start_pos", "end_pos", "move", "recovery_pos"))


@query("w13_rally_candidates", with_sql(B8, FEATURES, RALLY, select="SELECT symbol, s, e FROM rc"))
def candidates(spark, d):
    return events.rally_candidates(events.features(bars(spark, d, 8)))


@query("w15_rally_legs", with_sql(B8, FEATURES, RALLY, select="SELECT symbol, low.p start_pos, -high.b end_pos, round(high.c / low.c - 1, 8) AS move, e reach_pos FROM rl"))
def rallies(spark, d):
    return rounded(events.rally_legs(events.features(bars(spark, d, 8))).select("symbol", "start_pos", "end_pos", "move", "reach_pos"))


@query("w16_clusters", with_sql(B8, FEATURES, DD, UNDER, RALLY, LEGS, select="SELECT symbol, min(start_pos) s, max(end_pos) e, count(*) legs FROM cl GROUP BY symbol, cluster"))
def clusters(spark, d):
    b = bars(spark, d, 8)
    c = events.clustered(events.legs(events.features(b)))
    return c.groupBy("symbol", "cluster").agg(F.min("start_pos").alias("s"), F.max("end_pos").alias("e"), F.count("*").alias("legs")).drop("cluster")


@query("a24_closure_frontier", with_sql(B8, FEATURES, FRONTIER, select="SELECT symbol, CAST(frontier AS BIGINT) frontier FROM fr"))
def frontier(spark, d):
    return events.frontier(events.features(bars(spark, d, 8)))


@query("c10_detect", with_sql(*detect_sql(1), select=f"SELECT {EP_SELECT} FROM ep"))
def detect(spark, d):
    return rounded(events.detect(bars(spark, d)), 6)


@query("c10_detect_symbols", with_sql(*detect_sql(20), select=f"SELECT {EP_SELECT} FROM ep"))
def detect_symbols(spark, d):
    return rounded(events.detect(bars(spark, d, 20)), 6)


CUTS = ("1994-01-01", "1995-07-03", "1998-02-02")


@query("c10_detect_resumed", with_sql(*detect_sql(20), select=f"SELECT {EP_SELECT} FROM ep"))
def detect_resumed(spark, d):
    """Bars in four parts: each is read from the state that the one before left; what closed in each, and what is open after the last."""
    b, states, told, since = bars(spark, d, 20), None, [], None
    for until in (*CUTS, None):
        part = b if since is None else b.filter(F.col("date") >= F.lit(since).cast("date"))
        part = part if until is None else part.filter(F.col("date") < F.lit(until).cast("date"))
        path = fresh(spark, "resumed")
        resume.resume(part, states).write.parquet(path)
        done, since = spark.read.schema(resume.RESUMED).parquet(path), until
        states, episodes = resume.states_of(done), resume.episodes_of(done)
        told.append(episodes if until is None else episodes.filter("status = 'closed'"))
    return rounded(reduce(DataFrame.unionByName, told), 6)


@query("a23_duplicate_ids", with_sql(*detect_sql(8), "tw AS (SELECT symbol, episode_id FROM ep UNION ALL SELECT symbol, episode_id FROM ep WHERE trigger = 'gap')", select="SELECT symbol, episode_id, count(*) AS count FROM tw GROUP BY 1, 2 HAVING count(*) > 1"))
def duplicates(spark, d):
    """Detected episodes, those of gaps twice."""
    e = events.detect(bars(spark, d, 8))
    return events.duplicate_ids(e.withColumn("n", F.explode(F.when(F.col("trigger") == "gap", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))))


CAL = """sd AS (SELECT dt, row_number() OVER (ORDER BY dt) rn FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) dt FROM lineitem)),
cal AS (SELECT dt AS date, CASE rn % 3 WHEN 0 THEN 'FOMC' WHEN 1 THEN 'CPI' ELSE 'payrolls' END AS release, 'meeting' release_type, TRUE scheduled, 'https://example.org/' || year(dt) source_url FROM sd WHERE rn % 13 = 0
 UNION ALL SELECT dt, 'FOMC', 'unscheduled', FALSE, 'https://example.org/' || year(dt) FROM sd WHERE rn % 41 = 0)"""


def calendar(spark, d):
    """Every 13th ship date as a scheduled release, every 41st as an unscheduled one."""
    days = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    n = days.withColumn("rn", F.row_number().over(Window.orderBy("date")))  # days: bounded by the calendar
    url = F.concat(F.lit("https://example.org/"), F.year("date").cast("string"))
    name = F.when(F.col("rn") % 3 == 0, "FOMC").when(F.col("rn") % 3 == 1, "CPI").otherwise("payrolls")
    row = lambda release, kind, on: ("date", release.alias("release"), F.lit(kind).alias("release_type"), F.lit(on).alias("scheduled"), url.alias("source_url"))
    return n.filter("rn % 13 = 0").select(*row(name, "meeting", True)).unionByName(n.filter("rn % 41 = 0").select(*row(F.lit("FOMC"), "unscheduled", False)))


TAG = """tg AS (SELECT ep.*, coalesce(list(cal.release || ' ' || cal.date ORDER BY cal.date, cal.release, cal.release_type) FILTER (WHERE cal.scheduled), []) scheduled_releases,
 coalesce(list(cal.release || ' ' || cal.date ORDER BY cal.date, cal.release, cal.release_type) FILTER (WHERE NOT cal.scheduled), []) unscheduled_releases
 FROM ep LEFT JOIN cal ON cal.date BETWEEN search_from AND search_to GROUP BY ALL),
te AS (SELECT *, CASE WHEN len(scheduled_releases) > 0 THEN 'scheduled' ELSE 'surprise' END catalyst FROM tg)"""


def tagged(spark, d, symbols: int = 1):
    return macro.tag(events.detect(bars(spark, d, symbols)), calendar(spark, d))


@query("c11_tag_episodes", with_sql(*detect_sql(8), CAL, TAG, select="SELECT symbol, episode_id, array_to_string(scheduled_releases, '|') scheduled, array_to_string(unscheduled_releases, '|') unscheduled, catalyst FROM te"))
def tag(spark, d):
    t = tagged(spark, d, 8)
    return t.select("symbol", "episode_id", F.array_join("scheduled_releases", "|").alias("scheduled"), F.array_join("unscheduled_releases", "|").alias("unscheduled"), "catalyst")


@query("a12_episode_tallies", with_sql(*detect_sql(8), CAL, TAG, select=" UNION ALL ".join(f"SELECT '{c}' AS dimension, {e} AS value, count(*) n FROM te GROUP BY 2" for c, e in (("trigger", "trigger"), ("status", "status"), ("catalyst", "catalyst"), ("direction", "direction"), ("decade", "CAST(year(start_date) // 10 * 10 AS VARCHAR) || 's'")))))
def tallies(spark, d):
    return reports.episode_tallies(tagged(spark, d, 8))


_TWICE = """cr AS (SELECT *, source_url || '#' || n source FROM cal, (VALUES (1), (2)) v(n) WHERE n = 1 OR day(date) < 12)"""


@query("c12_merged_calendar", with_sql(CAL, _TWICE, select="SELECT row_number() OVER (ORDER BY date, release, release_type) nth, date, release, release_type, bool_or(scheduled) scheduled, max(source) source_url FROM cr GROUP BY date, release, release_type"))
def merged_calendar(spark, d):
    """A fresh calendar in which many rows stand twice; the later counts, and rows come in order."""
    rows = calendar(spark, d).withColumn("arrival", F.explode(F.when(F.dayofmonth("date") < 12, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    fresh_rows = rows.withColumn("source_url", F.concat("source_url", F.lit("#"), F.col("arrival").cast("string")))
    merged = macro.merge(calendar(spark, d).filter("release <> 'FOMC' OR scheduled"), fresh_rows, "2001-01-01")
    nth = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))  # as the rows come
    return merged.select(nth.cast("long").alias("nth"), "*")


@query("j2_probe", with_sql(*detect_sql(1), "pr AS (SELECT 'probe ' || CAST(m AS VARCHAR) AS label, make_date(1995, CAST(m AS INTEGER), 15) probe FROM (SELECT unnest(range(1, 13)) m))", select="SELECT pr.label, pr.probe, count(ep.episode_id) matches, min(ep.episode_id) episode_id, min(ep.trigger) AS trigger FROM pr LEFT JOIN ep ON pr.probe BETWEEN start_date AND end_date GROUP BY 1, 2"))
def probe(spark, d):
    probes = spark.range(1, 13).select(F.concat(F.lit("probe "), F.col("id").cast("string")).alias("label"), F.make_date(F.lit(1995), F.col("id").cast("int"), F.lit(15)).alias("probe"))
    return reports.containing(events.detect(bars(spark, d)), probes)


@query("j17_uncovered_releases", with_sql(*detect_sql(1), CAL, "w AS (SELECT max(search_to) through FROM ep)", "n(release) AS (VALUES ('FOMC'), ('CPI'), ('payrolls'), ('GDP'))", "l AS (SELECT n.release, max(cal.date) AS last FROM n LEFT JOIN cal ON cal.release = n.release GROUP BY 1)", select="SELECT l.release, l.last, w.through FROM l, w WHERE l.last IS NULL OR l.last < w.through"))
def uncovered(spark, d):
    return macro.uncovered(events.detect(bars(spark, d)), calendar(spark, d), ("FOMC", "CPI", "payrolls", "GDP"))


@query("a13_calendar_coverage", with_sql(CAL, select="SELECT release, count(*) n, min(date) AS first, max(date) AS last, CAST(count(*) FILTER (WHERE NOT scheduled) AS BIGINT) unscheduled FROM cal GROUP BY 1"))
def coverage(spark, d):
    return macro.coverage(calendar(spark, d))


@query("p7_drop_listed", with_sql(CAL, select="SELECT date, release, release_type, scheduled, source_url, 'kept' part FROM cal WHERE NOT (release = 'CPI' AND month(date) = 2) UNION ALL SELECT date, release, release_type, scheduled, source_url, 'dropped' FROM cal WHERE release = 'CPI' AND month(date) = 2"))
def drop_listed(spark, d):
    c = calendar(spark, d)
    listed = c.filter((F.col("release") == "CPI") & (F.month("date") == 2)).select("release", "date")
    kept, dropped = macro.drop_listed(c, listed)
    return kept.select(*macro.COLUMNS, F.lit("kept").alias("part")).unionByName(dropped.select(*macro.COLUMNS, F.lit("dropped").alias("part")))


@query("p8_horizon_trim", with_sql(CAL, select="SELECT * FROM cal WHERE date BETWEEN DATE '1996-06-01' AND DATE '1997-06-30' + 800"))
def trim(spark, d):
    return macro.trim(calendar(spark, d), "1997-06-30", replace(S, calendar_start="1996-06-01"))


_CHANGED = """nw AS (SELECT date, release, release_type, CASE WHEN day(date) = 7 THEN NOT scheduled ELSE scheduled END scheduled, source_url FROM cal WHERE day(date) <> 9)"""


@query("j6_calendar_differences", with_sql(CAL, _CHANGED, select="SELECT date, release, release_type, scheduled, 'removed' change FROM (SELECT date, release, release_type, scheduled FROM cal EXCEPT SELECT date, release, release_type, scheduled FROM nw) UNION ALL SELECT date, release, release_type, scheduled, 'added' FROM (SELECT date, release, release_type, scheduled FROM nw EXCEPT SELECT date, release, release_type, scheduled FROM cal)"))
def differences(spark, d):
    c = calendar(spark, d)
    return macro.differences(c, c.filter(F.day("date") != 9).withColumn("scheduled", F.when(F.day("date") == 7, ~F.col("scheduled")).otherwise(F.col("scheduled"))))


@query("c12_forbidden_changes", with_sql(CAL, _CHANGED, "df AS (SELECT date, release, release_type, scheduled, 'removed' change FROM (SELECT date, release, release_type, scheduled FROM cal EXCEPT SELECT date, release, release_type, scheduled FROM nw) UNION ALL SELECT date, release, release_type, scheduled, 'added' FROM (SELECT date, release, release_type, scheduled FROM nw EXCEPT SELECT date, release, release_type, scheduled FROM cal))", select="SELECT * FROM df WHERE date < DATE '1996-01-01' AND (change = 'removed' OR scheduled)"))
def forbidden(spark, d):
    c = calendar(spark, d)
    fresh = c.filter(F.day("date") != 9).withColumn("scheduled", F.when(F.day("date") == 7, ~F.col("scheduled")).otherwise(F.col("scheduled")))
    return macro.forbidden_changes(c, fresh, "1996-01-01")


@query("a22_latest_rows", with_sql(CAL, "twice AS (SELECT *, 1 arrival FROM cal UNION ALL SELECT date, release, release_type, NOT scheduled, source_url || '?v=2', 2 FROM cal WHERE month(date) = 6)", select="SELECT date, release, release_type, arg_max(scheduled, arrival) scheduled, arg_max(source_url, arrival) source_url FROM twice GROUP BY 1, 2, 3"))
def latest(spark, d):
    c = calendar(spark, d)
    again = c.filter(F.month("date") == 6).withColumns({"scheduled": ~F.col("scheduled"), "source_url": F.concat("source_url", F.lit("?v=2")), "arrival": F.lit(2)})
    return macro.latest(c.withColumn("arrival", F.lit(1)).unionByName(again))


@query("c13_calendar_violations", with_sql(CAL, """pm AS (SELECT release, strftime(date, '%Y-%m') mo, count(*) n FROM cal WHERE release IN ('CPI', 'payrolls') GROUP BY 1, 2),
fs AS (SELECT release, min(date) f FROM cal WHERE release IN ('CPI', 'payrolls') GROUP BY 1),
sp AS (SELECT y, r.* FROM (SELECT unnest(range(1993, 1998)) y), (VALUES ('FOMC', 7, 8), ('CPI', 10, 13), ('payrolls', 10, 13)) r(release, lo, hi)),
yr AS (SELECT y, sp.release, lo, hi, count(cal.date) n FROM sp LEFT JOIN cal ON year(cal.date) = y AND cal.release = sp.release AND (sp.release <> 'FOMC' OR scheduled) GROUP BY ALL)""", select="""SELECT 'duplicate' AS "check", date || ' ' || release || ' ' || release_type AS detail FROM cal GROUP BY date, release, release_type HAVING count(*) > 1
UNION ALL SELECT 'range', date || ' ' || release FROM cal WHERE date < DATE '1993-01-01' OR date > DATE '1998-03-01' + 800
UNION ALL SELECT 'month', release || ' ' || mo || ' ' || n FROM pm WHERE n > 1 AND NOT (release = 'CPI' AND mo = '1996-02')
UNION ALL SELECT 'first', release || ' ' || f FROM fs WHERE f > DATE '1993-02-28'
UNION ALL SELECT 'year', y || ' ' || release || ' ' || n FROM yr WHERE n NOT BETWEEN lo AND hi"""))
def calendar_violations(spark, d):
    return macro.violations(calendar(spark, d), "1998-03-01")


_MONTH = "['January','February','March','April','May','June','July','August','September','October','November','December'][month]"
_PAGE_DAYS = "pd AS (SELECT DISTINCT year(o_orderdate) AS year, month(o_orderdate) AS month, 3 + (year(o_orderdate) + month(o_orderdate)) % 20 d1 FROM orders)"


def _page_days(spark, d):
    o = table(spark, d, "orders")
    y, m = F.year("o_orderdate"), F.month("o_orderdate")
    return o.select(y.alias("year"), m.alias("month"), (3 + (y + m) % 20).alias("d1")).distinct().withColumn("name", F.element_at(F.array(*[F.lit(x.title()) for x in text.MONTHS]), F.col("month")))


@query("s14_year_pages", with_sql(_PAGE_DAYS, select="SELECT make_date(CAST(year AS INTEGER), CAST(month AS INTEGER), CAST(d1 + CASE WHEN month % 3 = 0 THEN 1 ELSE 0 END AS INTEGER)) AS date, 'FOMC' AS release, CASE WHEN month % 5 = 0 OR month = 4 THEN 'unscheduled' ELSE 'meeting' END release_type, NOT (month % 5 = 0 OR month = 4) scheduled, 'https://example.org/' || year source_url FROM pd WHERE month <> 7"))
def year_pages(spark, d):
    """Pages of past years made from the months that hold orders, and read again."""
    days = F.when(F.col("month") % 3 == 0, F.concat_ws("-", F.col("d1"), F.col("d1") + 1)).otherwise(F.col("d1").cast("string"))
    note = F.when(F.col("month") == 7, " (cancelled)").when(F.col("month") == 4, " (unscheduled)").otherwise("")
    kind = F.when(F.col("month") % 5 == 0, "Conference&nbsp;Call").otherwise("Meeting")
    entry = F.concat(F.lit("<h5>"), "name", F.lit("&nbsp;"), days, note, F.lit(" "), kind, F.lit(" - "), F.col("year"), F.lit("</h5><p>Released January 1, 1999 Meeting - 1900</p>"))
    p = _page_days(spark, d).groupBy("year").agg(F.array_join(F.collect_list(entry), "\n").alias("html"))
    return macro.parse_year_pages(p.withColumn("source_url", F.concat(F.lit("https://example.org/"), F.col("year"))))


@query("s15_current_page", with_sql(_PAGE_DAYS, select="SELECT CASE WHEN month = 1 THEN make_date(CAST(year AS INTEGER), 2, 1) ELSE make_date(CAST(year AS INTEGER), CAST(month AS INTEGER), CAST(d1 + CASE WHEN month % 2 = 0 THEN 1 ELSE 0 END AS INTEGER)) END AS date, 'FOMC' AS release, CASE WHEN month = 3 THEN 'unscheduled' ELSE 'meeting' END release_type, month <> 3 scheduled, 'https://example.org/now' source_url FROM pd WHERE month <> 5"))
def current_page(spark, d):
    """One page with a section for each year, made from the months that hold orders, and read again."""
    days = F.when(F.col("month") % 2 == 0, F.concat(F.concat_ws("-", F.col("d1"), F.col("d1") + 1), F.lit("*"))).otherwise(F.col("d1").cast("string"))
    note = F.when(F.col("month") == 5, " (notation vote)").when(F.col("month") == 3, " (unscheduled)").otherwise("")
    entry = F.when(F.col("month") == 1, F.lit("<b>Jan/Feb</b> 31-1 <a>Statement</a>")).otherwise(F.concat(F.lit("<b>"), "name", F.lit("</b> "), days, note, F.lit(" <a>Statement</a>: PDF (Released May 1, 1990)")))
    section = F.concat(F.lit("<h4>"), F.col("year"), F.lit(" FOMC Meetings</h4>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("month", entry.alias("e")))), lambda x: x["e"]), " "))
    sections = _page_days(spark, d).groupBy("year").agg(section.alias("s"))
    page = sections.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("year", "s"))), lambda x: x["s"]), "\n").alias("html"))  # a section a year
    return macro.parse_current_page(page.withColumn("source_url", F.lit("https://example.org/now")))


@query("s17_release_dates", with_sql(_PAGE_DAYS, select="SELECT make_date(CAST(year AS INTEGER), CAST(month AS INTEGER), CAST(d1 AS INTEGER)) AS date, 'CPI' AS release, 'release' release_type, TRUE scheduled, 'https://alfred.stlouisfed.org/releases/calendar?rid=10&y=' || year source_url FROM pd"))
def release_dates(spark, d):
    day = F.make_date("year", "month", "d1").cast("string")
    p = _page_days(spark, d).groupBy().agg(F.collect_list(F.struct(F.lit(10).alias("release_id"), day.alias("date"))).alias("release_dates"))
    payload = p.select(F.to_json(F.struct(F.size("release_dates").alias("count"), F.lit(0).alias("offset"), F.lit(10000).alias("limit"), "release_dates")).alias("json"))
    return macro.parse_release_dates(payload.withColumns({"release": F.lit("CPI"), "release_type": F.lit("release")}))


_HOLIDAYS = """ys AS (SELECT unnest(range(1984, 2031)) y),
ea AS (SELECT y, y % 19 a, y // 100 b, y % 100 c FROM ys), eb AS (SELECT *, (19*a + b - b//4 - (b - (b+8)//25 + 1)//3 + 15) % 30 h, b % 4 e, c // 4 i, c % 4 k FROM ea),
ec AS (SELECT *, (32 + 2*e + 2*i - h - k) % 7 l FROM eb), ed AS (SELECT *, (a + 11*h + 22*l)//451 m FROM ec),
gf AS (SELECT CAST(make_date(CAST(y AS INTEGER), CAST((h + l - 7*m + 114)//31 AS INTEGER), CAST((h + l - 7*m + 114) % 31 + 1 AS INTEGER)) - 2 AS DATE) AS date FROM ed),
dy AS (SELECT CAST(d AS DATE) AS date, month(d) m, day(d) dd, isodow(d) w, year(d) y FROM range(DATE '1985-01-01', DATE '2027-01-01', INTERVAL 1 DAY) t(d)),
ho AS (SELECT date FROM dy WHERE (m = 1 AND dd = 1 AND w <> 7) OR (m = 1 AND dd = 2 AND w = 1) OR (m = 1 AND w = 1 AND dd BETWEEN 15 AND 21 AND y >= 1998) OR (m = 2 AND w = 1 AND dd BETWEEN 15 AND 21)
 OR (m = 5 AND w = 1 AND dd >= 25) OR (y >= 2022 AND m = 6 AND ((dd = 19 AND w < 6) OR (dd = 18 AND w = 5) OR (dd = 20 AND w = 1))) OR (m = 7 AND ((dd = 4 AND w < 6) OR (dd = 3 AND w = 5) OR (dd = 5 AND w = 1)))
 OR (m = 9 AND w = 1 AND dd <= 7) OR (m = 11 AND w = 4 AND dd BETWEEN 22 AND 28) OR (m = 12 AND ((dd = 25 AND w < 6) OR (dd = 24 AND w = 5) OR (dd = 26 AND w = 1)))
 UNION SELECT date FROM gf WHERE date BETWEEN DATE '1993-01-01' AND DATE '2026-12-31'
 UNION SELECT CAST(x AS DATE) FROM (VALUES """ + ", ".join(f"('{x}')" for x in sessions.SPECIAL_CLOSURES) + """) v(x))"""


_SPANS = "rg AS (SELECT symbol, min(date) lo, max(date) hi FROM bars GROUP BY 1)"


@query("f28_business_days", with_sql(bars_sql(50), _SPANS, select="SELECT symbol, CAST(d AS DATE) AS date FROM rg, LATERAL (SELECT unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) d) WHERE isodow(d) < 6"))
def business_days(spark, d):
    return sessions.business_days_in(sessions.symbol_spans(bars(spark, d, 50)))


@query("f29_holidays", with_sql(bars_sql(50), _HOLIDAYS, _SPANS, select="SELECT symbol, ho.date FROM ho JOIN rg ON ho.date BETWEEN lo AND hi"))
def holidays(spark, d):
    return sessions.holidays_in(sessions.symbol_spans(bars(spark, d, 50))).select("symbol", "date")


@query("u3_sessions", with_sql(bars_sql(50), _HOLIDAYS, _SPANS, select="SELECT symbol, dy.date FROM dy JOIN rg ON dy.date BETWEEN lo AND hi WHERE w < 6 AND dy.date NOT IN (SELECT date FROM ho)"))
def session_query(spark, d):
    return sessions.sessions_in(sessions.symbol_spans(bars(spark, d, 50)))


@query("j7_missing_sessions", with_sql(bars_sql(50), _HOLIDAYS, "rg AS (SELECT symbol, min(date) lo, max(date) hi FROM bars GROUP BY 1)", select="SELECT symbol, dy.date FROM dy JOIN rg ON dy.date BETWEEN lo AND hi WHERE w < 6 AND dy.date NOT IN (SELECT date FROM ho) AND NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = rg.symbol AND b.date = dy.date)"))
def missing(spark, d):
    return sessions.missing_sessions(bars(spark, d, 50), sessions.sessions(spark, "1993-01-01", "2026-12-31"))


_SNAP = "nb AS (SELECT symbol, date, open, high, low, CASE WHEN day(date) = 15 THEN close * 1.01 ELSE close END AS close, adj_close * (1 + (year(date) - 1990) * 0.001) AS adj_close, volume FROM bars)"


def _new_snapshot(spark, d):
    b = bars(spark, d)
    return b, b.withColumns({"close": F.when(F.day("date") == 15, F.col("close") * F.lit(1.01)).otherwise(F.col("close")), "adj_close": F.col("adj_close") * (1 + (F.year("date") - 1990) * F.lit(0.001))})


@query("a17_rewrites", with_sql(B, _SNAP, select="SELECT b.symbol, 'close' AS \"column\", count(*) changed, min(b.date) first_date FROM bars b JOIN nb ON nb.symbol = b.symbol AND nb.date = b.date WHERE abs(nb.close / b.close - 1) > 0.0001 GROUP BY 1"))
def rewrites(spark, d):
    return snapshots.rewrites(*_new_snapshot(spark, d), S.rewrite_tolerance)


@query("a16_factor_spread", with_sql(B, _SNAP, select="SELECT b.symbol, round(max(nb.adj_close / b.adj_close) / min(nb.adj_close / b.adj_close) - 1, 8) spread FROM bars b JOIN nb ON nb.symbol = b.symbol AND nb.date = b.date GROUP BY 1"))
def spread(spark, d):
    return rounded(snapshots.factor_spread(*_new_snapshot(spark, d)))


@query("c14_snapshot_violations", with_sql(B, _HOLIDAYS, _SNAP, "cut AS (SELECT * FROM nb WHERE date < DATE '1999-01-01')", "rg AS (SELECT symbol, min(date) lo, max(date) hi FROM cut GROUP BY 1)", select="""SELECT 'S0' symbol, 'rows' AS "check", (SELECT count(*) FROM cut) || '<' || (SELECT count(*) FROM bars) AS detail
UNION ALL SELECT 'S0', 'last_date', (SELECT max(date) FROM cut) || '<' || (SELECT max(date) FROM bars)
UNION ALL SELECT b.symbol, 'rewrite', 'close ' || count(*) || ' ' || min(b.date) FROM bars b JOIN cut ON cut.date = b.date WHERE abs(cut.close / b.close - 1) > 0.0001 GROUP BY 1
UNION ALL SELECT b.symbol, 'adj_factor', printf('%.6f', max(cut.adj_close / b.adj_close) / min(cut.adj_close / b.adj_close) - 1) FROM bars b JOIN cut ON cut.date = b.date GROUP BY 1
UNION ALL SELECT symbol, 'missing_session', CAST(dy.date AS VARCHAR) FROM dy JOIN rg ON dy.date BETWEEN lo AND hi WHERE w < 6 AND dy.date NOT IN (SELECT date FROM ho) AND dy.date NOT IN (SELECT date FROM cut)"""))
def snapshot_violations(spark, d):
    old, new = _new_snapshot(spark, d)
    return snapshots.violations(old, new.filter("date < DATE '1999-01-01'"), sessions.sessions(spark, "1993-01-01", "2000-12-31"))


@query("f31_staleness", "SELECT o_orderkey AS symbol, o_orderdate refreshed_at, CAST(floor(epoch(TIMESTAMP '1996-07-01 12:00:00' - o_orderdate) / 86400) AS BIGINT) age_days, CAST(floor(epoch(TIMESTAMP '1996-07-01 12:00:00' - o_orderdate) / 86400) AS BIGINT) > 3 stale FROM orders")
def staleness(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("refreshed_at"))
    return snapshots.stale(o, "1996-07-01 12:00:00")


@query("j5_overlap", with_sql(B, select="SELECT symbol, date, close AS old_close, close AS new_close FROM bars WHERE year(date) BETWEEN 1997 AND 1998"))
def overlap(spark, d):
    b = bars(spark, d)
    return b.select("symbol", "date", F.col("close").alias("old_close")).filter("year(date) <= 1998").join(b.select("symbol", "date", F.col("close").alias("new_close")).filter("year(date) >= 1997"), ["symbol", "date"])


@query("u2_change_counts", with_sql(CAL, _CHANGED, "a AS (SELECT date, release, release_type, scheduled FROM cal)", "b AS (SELECT date, release, release_type, scheduled FROM nw)", select="SELECT 'removed' change, count(*) n FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'added', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"))
def change_counts(spark, d):
    c = calendar(spark, d)
    return macro.change_counts(c, c.filter(F.day("date") != 9).withColumn("scheduled", F.when(F.day("date") == 7, ~F.col("scheduled")).otherwise(F.col("scheduled"))))


@query("s4_episodes_file", with_sql(*detect_sql(8), CAL, TAG, select="SELECT symbol, episode_id, start_date, status, round(move_pct, 6) move_pct, array_to_string(scheduled_releases, '|') scheduled, catalyst FROM te"))
def episodes_file(spark, d):
    """Tagged episodes, written by the sink, whose check of ids has to pass, and read back."""
    path = fresh(spark, "episodes")
    files.write_episodes(tagged(spark, d, 8), path, events.require_unique_ids)
    e = files.read_table(spark, path, files.EPISODE_SCHEMA)
    return rounded(e.select("symbol", "episode_id", "start_date", "status", "move_pct", F.array_join("scheduled_releases", "|").alias("scheduled"), "catalyst"), 6)


@query("s4_calendar_file", with_sql(CAL, select="SELECT * FROM cal"))
def calendar_file(spark, d):
    path = fresh(spark, "calendar")
    files.write_calendar(calendar(spark, d), path)
    return files.read_table(spark, path, files.CALENDAR_SCHEMA)


@query("s6_records_document", with_sql(*detect_sql(1), CAL, TAG, select="SELECT episode_id, 'unexplained' status, catalyst = 'scheduled' scheduled, search_from, search_to, 'v1' prompt_version, 'then' enriched_at FROM te"))
def records_document(spark, d):
    """The null provider's records of all episodes, written as a document and read back."""
    e, path = narrowed(tagged(spark, d)), fresh(spark, "records.json")
    files.write_rows(to_records(null_explanations(e), e, "then"), path, "records", "episode_id")
    return files.read_rows(spark, path, "records", files.RECORD_SCHEMA, missing_ok=False).select("episode_id", "status", "scheduled", "search_from", "search_to", "prompt_version", "enriched_at")


@query("s7_overrides_document", with_sql(*detect_sql(1), select="SELECT episode_id, CASE trigger WHEN 'gap' THEN 'accept' WHEN 'shock' THEN 'reject' ELSE 'edit' END action, CASE WHEN trigger NOT IN ('gap', 'shock') THEN 'about ' || episode_id END headline, 'now' reviewed_at FROM ep"))
def overrides_document(spark, d):
    """An override for each episode, written as a document, and checked where it is read."""
    e, path = events.detect(bars(spark, d)), fresh(spark, "overrides.json")
    fields = F.when(~F.col("trigger").isin("gap", "shock"), F.create_map(F.lit("headline"), F.concat(F.lit("about "), "episode_id")))
    action = F.when(F.col("trigger") == "gap", "accept").when(F.col("trigger") == "shock", "reject").otherwise("edit")
    write_overrides(e.select("episode_id", action.alias("action"), fields.alias("fields"), F.lit("now").alias("reviewed_at"), F.lit("").alias("note")), path)
    return read_overrides(spark, path).select("episode_id", "action", F.col("fields")["headline"].alias("headline"), "reviewed_at")


@query("s8_ledger_document", with_sql(*detect_sql(1), select="SELECT 'run ' || year(start_date) run_id, count(*) episodes_attempted, round(sum(abs(move_pct)), 6) cost_usd FROM ep GROUP BY 1"))
def ledger_document(spark, d):
    """A run for each year of episodes, written as a document and read back."""
    path = fresh(spark, "ledger.json")
    runs = events.detect(bars(spark, d)).groupBy(F.concat(F.lit("run "), F.year("start_date")).alias("run_id")).agg(F.count("*").alias("episodes_attempted"), F.sum(F.abs("move_pct")).alias("cost_usd"))
    files.write_rows(runs, path, "runs", "run_id")
    return rounded(files.read_rows(spark, path, "runs", files.LEDGER_SCHEMA).select("run_id", "episodes_attempted", "cost_usd"), 6)


@query("f11_bad_ids", with_sql(*detect_sql(8), "ids AS (SELECT CASE WHEN month(start_date) = 6 THEN replace(episode_id, '-0', '-9') WHEN month(start_date) = 7 THEN episode_id || 'x' ELSE episode_id END episode_id FROM ep)", select="SELECT episode_id FROM ids WHERE NOT regexp_full_match(episode_id, '\\d{4}-\\d{2}-\\d{2}_(shock|gap|drawdown|rally)') OR try_cast(episode_id[1:10] AS DATE) IS NULL"))
def ids_at_fault(spark, d):
    e = events.detect(bars(spark, d, 8))
    return bad_ids(e.select(F.when(F.month("start_date") == 6, F.replace("episode_id", F.lit("-0"), F.lit("-9"))).when(F.month("start_date") == 7, F.concat("episode_id", F.lit("x"))).otherwise(F.col("episode_id")).alias("episode_id")))
