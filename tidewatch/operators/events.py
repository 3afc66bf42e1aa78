"""Shocks, gaps, drawdowns and rallies; clustered to episodes whose closed ones never change.

Everything is in bar positions.  Each stage is a window or an aggregation by symbol, so symbols run side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import SETTINGS, Settings
from .indicators import by_date
from .regimes import episodes_under_water, with_positions

LEG = ("symbol", "kind", "start_pos", "end_pos", "move", "recovery_pos", "reach_pos")


def features(bars: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """symbol, date, pos, n, open, close, prev, ret (log), z, gap.

    z is the return over the deviation of the sigma_window returns before it; a deviation of 0 gives infinity, or null
    for a return of 0.
    """
    d = with_positions(bars.select("symbol", "date", "open", "close"))
    d = d.withColumn("n", F.count("*").over(Window.partitionBy("symbol"))).withColumn("prev", F.lag("close").over(by_date()))
    d = d.withColumn("ret", F.when((F.col("prev") > 0) & (F.col("close") > 0), F.ln(F.col("close") / F.col("prev"))))
    frame = by_date().rowsBetween(-settings.sigma_window, -1)
    sd = F.when(F.count("ret").over(frame) == settings.sigma_window, F.stddev_samp("ret").over(frame))
    d = d.withColumn("sd", sd)
    z = F.when(F.col("sd") > 0, F.col("ret") / F.col("sd")).when((F.col("sd") == 0) & (F.col("ret") != 0), F.signum("ret") * F.lit(float("inf")))
    gap = F.when(F.col("prev") > 0, F.col("open") / F.col("prev") - 1)
    return d.withColumn("z", z).withColumn("gap", gap).drop("sd")


def _day(f: DataFrame, kind: str, when: Column) -> DataFrame:
    none = F.lit(None).cast("long")
    return f.filter(when).select("symbol", F.lit(kind).alias("kind"), F.col("pos").alias("start_pos"), F.col("pos").alias("end_pos"), F.col("ret").alias("move"), none.alias("recovery_pos"), none.alias("reach_pos"))


def _shock(settings: Settings) -> Column:
    return F.abs("z") > settings.z_threshold


def _gap(settings: Settings) -> Column:
    return F.abs("gap") > settings.gap_threshold


def shock_legs(f: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    return _day(f, "shock", _shock(settings))


def gap_legs(f: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """A gap's move is the day's log return."""
    return _day(f, "gap", _gap(settings))


def drawdown_legs(bars: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    e = episodes_under_water(bars).filter(F.col("depth") <= -settings.drawdown_threshold)
    return e.select("symbol", F.lit("drawdown").alias("kind"), F.col("peak_pos").alias("start_pos"), F.col("trough_pos").alias("end_pos"), F.col("depth").alias("move"), "recovery_pos", F.lit(None).cast("long").alias("reach_pos"))


def _low(settings: Settings) -> Column:
    """Earliest lowest bar of the window that ends at a bar, rally_window + 1 bars."""
    return F.min(F.struct("close", "pos")).over(by_date().rowsBetween(-settings.rally_window, 0))


def _rallies(settings: Settings) -> Column:
    return (F.col("low.close") > 0) & (F.col("close") / F.col("low.close") - 1 >= settings.rally_threshold)


def rally_candidates(f: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """symbol, s (earliest lowest bar of the window that ends at e), e."""
    d = f.withColumn("low", _low(settings)).filter(_rallies(settings))
    return d.select("symbol", F.col("low.pos").alias("s"), F.col("pos").alias("e"))


def islands(df: DataFrame, start: str, end: str, reach: int, order: tuple[str, ...], name: str) -> DataFrame:
    """name: number of the group of rows that a sweep in order joins while start <= running end + reach."""
    w = Window.partitionBy("symbol").orderBy(*order)
    ends = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (ends.isNull() | (F.col(start) > ends + reach)).cast("long")
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def with_spans(f: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """f with span: the start of the rally span that a bar lies in, null outside.

    Touching candidates merge to spans.  The lowest bar of a sliding window only moves on, so candidates in the order
    of their ends are in the order of their starts too, and a span is a run of these.  A bar lies in the span of the
    next candidate from it, if it isn't before that span's start.
    """
    so_far, back = by_date().rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("symbol").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    d = f.withColumn("low", _low(settings)).withColumn("s", F.when(_rallies(settings), F.col("low.pos")))
    before = F.max(F.when(F.col("s").isNotNull(), F.col("pos"))).over(by_date().rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("before", before).withColumn("opens", F.when(F.col("s").isNotNull() & (F.col("before").isNull() | (F.col("s") > F.col("before"))), F.col("s")))
    d = d.withColumn("of", F.when(F.col("s").isNotNull(), F.max("opens").over(so_far)))
    return d.withColumn("next", F.last("of", ignorenulls=True).over(back)).withColumn("span", F.when(F.col("pos") >= F.col("next"), F.col("next"))).drop("low", "s", "before", "opens", "of", "next")


def legs(f: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """All legs of features' bars, in one pass of windows over each symbol's bars: a bar tells the legs that it ends or starts.

    A drawdown is told by its peak's bar, a rally by its span's last.  A rally's trough is the span's earliest low, its
    peak the earliest high from there; reach is the span's end.
    """
    so_far = by_date().rowsBetween(Window.unboundedPreceding, 0)
    d = with_spans(f, settings).withColumn("peak", F.max("close").over(so_far)).withColumn("grp", F.sum((F.col("close") == F.col("peak")).cast("long")).over(so_far))
    under, span = Window.partitionBy("symbol", "grp"), Window.partitionBy("symbol", "span")
    d = d.withColumns({"first": F.min("pos").over(under), "back": F.max("pos").over(under) + 1, "trough": F.min(F.struct("close", "pos")).over(under)})
    d = d.withColumns({"low": F.min(F.struct("close", "pos")).over(span), "reach": F.max("pos").over(span)})
    d = d.withColumn("high", F.max(F.when(F.col("pos") >= F.col("low.pos"), F.struct("close", (-F.col("pos")).alias("b")))).over(span))
    none, pos = F.lit(None).cast("long"), F.col("pos")
    leg = lambda when, kind, start, end, move, back=none, reach=none: F.when(when, F.struct(F.lit(kind).alias("kind"), start.alias("start_pos"), end.alias("end_pos"), move.alias("move"), back.alias("recovery_pos"), reach.alias("reach_pos")))
    depth = F.col("trough.close") / F.when(F.col("close") != 0, F.col("close")) - 1
    told = F.array(
        leg(_shock(settings), "shock", pos, pos, F.col("ret")),
        leg(_gap(settings), "gap", pos, pos, F.col("ret")),
        leg((pos == F.col("first")) & (F.col("trough.close") < F.col("close")) & (depth <= -settings.drawdown_threshold), "drawdown", pos, F.col("trough.pos"), depth, F.when(F.col("back") < F.col("n"), F.col("back"))),
        leg(pos == F.when(F.col("span").isNotNull(), F.col("reach")), "rally", F.col("low.pos"), -F.col("high.b"), F.col("high.close") / F.col("low.close") - 1, none, F.col("reach")),
    )
    return d.select("symbol", F.explode(F.filter(told, lambda x: x.isNotNull())).alias("leg")).select("symbol", "leg.*")


def rally_legs(f: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    return legs(f, settings).filter("kind = 'rally'")


def clustered(leg_frame: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Legs with the number of their cluster: a leg joins while it starts within merge_window bars of the cluster's end."""
    return islands(leg_frame, "start_pos", "end_pos", settings.merge_window, ("start_pos", "end_pos", "kind"), "cluster")


def _frontier(settings: Settings) -> Column:
    """The first position that later bars may still touch, as an aggregate over a symbol's bars."""
    n, top, last = F.count("*"), F.max(F.struct("close", "pos")), F.max_by("close", "pos")
    return F.least(n - settings.rally_window, F.when(last < top["close"], top["pos"]).otherwise(n), n)


def frontier(f: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """symbol, frontier."""
    return f.groupBy("symbol").agg(_frontier(settings).alias("frontier"))


def detect(bars: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Episodes: 15 columns and symbol.

    Windows, clusters and the lookups by position all keep the one partitioning by symbol.  A symbol's bars are
    gathered to an array, a few numbers for each day, so its size is bounded by the calendar; clusters meet it in a
    join by symbol and read their days from it by position.
    """
    f = features(bars, settings)
    c = clustered(legs(f, settings), settings)
    rank = F.array_position(F.array(*map(F.lit, settings.precedence)), F.col("kind"))
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    g = c.groupBy("symbol", "cluster").agg(
        F.min("start_pos").alias("s"), F.max("end_pos").alias("e"), F.max(F.coalesce("reach_pos", "end_pos")).alias("reach"),
        F.element_at(F.array(*map(F.lit, settings.precedence)), F.min(rank).cast("int")).alias("trigger"),
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("triggers"),
        F.min(of("drawdown", F.col("move"))).alias("worst"), F.max(of("rally", F.col("move"))).alias("best"),
        F.count_if((F.col("kind") == "drawdown") & F.col("recovery_pos").isNull()).alias("unrecovered"), F.max(of("drawdown", F.col("recovery_pos"))).alias("recovery_pos"),
    )
    series = f.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("pos", "date", "close", "ret", "z"))).alias("days"), F.count("*").alias("n"), _frontier(settings).alias("frontier"))
    d = g.join(series.withColumnRenamed("symbol", "of"), F.col("symbol") == F.col("of")).drop("of")
    day = lambda pos: F.get("days", pos.cast("int"))
    d = d.withColumn("inside", F.slice("days", (F.col("s") + 1).cast("int"), (F.col("e") - F.col("s") + 1).cast("int")))
    moved = F.filter("inside", lambda x: x["ret"].isNotNull())
    sizes = F.transform(F.filter("inside", lambda x: x["z"].isNotNull()), lambda x: F.abs(x["z"]))
    d = d.withColumns({
        "anchor": F.array_max(F.transform(moved, lambda x: F.struct(F.abs(x["ret"]).alias("a"), (-x["pos"]).alias("b"), x["ret"].alias("ret")))),
        "max_z": F.when(F.exists(sizes, lambda x: x < float("inf")), F.array_max(sizes)).otherwise(0.0),
        "steep": F.when(F.col("trigger") == "drawdown", F.array_min(F.transform(moved, lambda x: F.struct(x["ret"].alias("ret"), x["pos"].alias("pos"))))["pos"])
        .when(F.col("trigger") == "rally", -F.array_max(F.transform(moved, lambda x: F.struct(x["ret"].alias("ret"), (-x["pos"]).alias("b"))))["b"]),
        "recovery_pos": F.when(F.col("unrecovered") == 0, F.col("recovery_pos")),
    })
    clamp = lambda x: F.least(F.greatest(x, F.lit(0)), F.col("n") - 1)
    from_pos = clamp(F.coalesce(F.col("steep") - settings.search_half_width, F.col("s") - settings.search_pre))
    to_pos = clamp(F.coalesce(F.col("steep") + settings.search_half_width, F.col("e") + settings.search_post))
    grown = day(F.col("e"))["close"] / day(F.greatest(F.col("s") - 1, F.lit(0)))["close"] - 1
    closed = (F.col("reach") + settings.merge_window < F.col("frontier")) & (F.col("unrecovered") == 0)
    d = d.select(
        "symbol", "trigger", "triggers", "max_z",
        day(F.col("s"))["date"].alias("start_date"), day(F.col("e"))["date"].alias("end_date"), day(-F.col("anchor.b"))["date"].alias("anchor_date"),
        F.when(F.col("trigger") == "drawdown", "down").when(F.col("trigger") == "rally", "up").when(F.col("anchor.ret") < 0, "down").otherwise("up").alias("direction"),
        F.when(F.col("trigger") == "drawdown", F.col("worst")).when(F.col("trigger") == "rally", F.col("best")).otherwise(grown).alias("move_pct"),
        day(from_pos)["date"].alias("search_from"), day(to_pos)["date"].alias("search_to"), day(F.col("recovery_pos"))["date"].alias("recovery_date"),
        F.when(closed, "closed").otherwise("open").alias("status"),
    )
    return d.select(
        "symbol", F.concat_ws("_", F.date_format("anchor_date", "yyyy-MM-dd"), "trigger").alias("episode_id"),
        "start_date", "end_date", "anchor_date", "direction", "trigger", "triggers", "move_pct", "max_z",
        (F.col("max_z") + F.abs("move_pct") / settings.severity_step).alias("severity"),
        "search_from", "search_to", "recovery_date", "status", F.lit(settings.detector_version).alias("detector_version"),
    )


def duplicate_ids(episodes: DataFrame) -> DataFrame:
    """Ids that stand more than once in a symbol; there should be none."""
    return episodes.groupBy("symbol", "episode_id").count().filter("count > 1")


def require_unique_ids(episodes: DataFrame) -> DataFrame:
    found = duplicate_ids(episodes).limit(10).collect()
    if found:
        raise ValueError(f"duplicate episode ids: {[r.episode_id for r in found]}")
    return episodes
