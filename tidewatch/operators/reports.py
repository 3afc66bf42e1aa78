"""Tallies for reports, and their text.

A report is text made of frames, each of few rows; the same frames give the same text.
"""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import decade
from ..settings import SETTINGS, Settings
from . import enrichment as E
from .macro import coverage
from .ranges import interval_places, point_places


def episode_tallies(episodes: DataFrame) -> DataFrame:
    """dimension, value, n for trigger, status, catalyst, direction and decade, in one pass of grouping sets."""
    d = episodes.withColumn("decade", decade(F.col("start_date")))
    dims = ("trigger", "status", "catalyst", "direction", "decade")
    g = d.groupingSets([[F.col(c)] for c in dims], *[F.col(c) for c in dims]).agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"g_{c}") for c in dims])
    which = F.coalesce(*[F.when(F.col(f"g_{c}") == 0, c) for c in dims])
    value = F.coalesce(*[F.when(F.col(f"g_{c}") == 0, F.col(c)) for c in dims])
    return g.select(which.alias("dimension"), value.alias("value"), "n")


def containing(episodes: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (label, probe) with the episodes whose days hold probe, and how many there are; they meet in buckets of the episodes' lengths."""
    spans = episodes.select("symbol", "episode_id", "start_date", "end_date", "trigger", F.explode(interval_places(F.col("start_date"), F.col("end_date"))).alias("_at"))
    points = probes.select("label", "probe", F.explode_outer(point_places(F.col("probe"))).alias("_there"))
    d = points.join(spans, (F.col("_there") == F.col("_at")) & F.col("probe").between(F.col("start_date"), F.col("end_date")), "left")
    return d.groupBy("label", "probe").agg(F.count("episode_id").alias("matches"), F.min("episode_id").alias("episode_id"), F.min("trigger").alias("trigger"))


def require_one(matches: DataFrame) -> DataFrame:
    bad = matches.filter("matches <> 1").limit(10).collect()
    if bad:
        raise ValueError("; ".join(f"{r.label}: {r.matches} episodes" for r in bad))
    return matches


def record_tallies(records: DataFrame) -> DataFrame:
    """dimension, value, n over statuses, models, dropped reasons and stop reasons of explanation records."""
    of = lambda d, name, c: d.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("dimension"), "value", "n")
    dropped = records.select(F.explode("dropped_sources").alias("d")).select(F.col("d.reason").alias("reason"))
    stops = records.select(F.explode("stop_reasons").alias("stop"))
    return of(records, "status", "status").unionByName(of(records, "model", "model")).unionByName(of(dropped, "dropped", "reason")).unionByName(of(stops, "stop", "stop"))


def search_usage(records: DataFrame) -> DataFrame:
    n = F.coalesce("usage.web_search_requests", F.lit(0))
    return records.agg(F.coalesce(F.sum(n), F.lit(0)).alias("total"), F.coalesce(F.max(n), F.lit(0)).alias("most"))


def drop_reasons(records: DataFrame) -> DataFrame:
    """Each record's distinct reasons, in order, as text."""
    return records.select("episode_id", F.array_join(F.array_sort(F.array_distinct(F.transform("dropped_sources", lambda x: x["reason"]))), ", ").alias("reasons"))


def missing_records(episodes: DataFrame, current: DataFrame) -> DataFrame:
    return episodes.filter("status = 'closed'").select("episode_id").join(current.select("episode_id"), "episode_id", "left_anti").orderBy("episode_id")


def _cell(x) -> str:
    return "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x)


def table(df: DataFrame, order: tuple[str, ...] = (), most: int = 1000) -> list[str]:
    """A frame's rows as a table of text, in an order that is all of its columns' where none is given; more than most rows are an error."""
    rows = df.orderBy(*(order or df.columns)).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    return ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |", *("| " + " | ".join(map(_cell, r)) + " |" for r in rows), ""]


def listing(df: DataFrame, most: int = 1000) -> list[str]:
    """The values of a frame's one column as a list; (none) if there are none."""
    rows = df.orderBy(*df.columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    return [*(f"- {r[0]}" for r in rows), ""] if rows else ["(none)", ""]


def thresholds(settings: Settings, prefix: tuple[str, ...] = ()) -> list[str]:
    """The settings, or those whose names start with one of prefix, by name."""
    rows = [(f.name, getattr(settings, f.name)) for f in fields(settings) if not prefix or f.name.startswith(prefix)]
    return ["| Field | Value |", "| --- | --- |", *(f"| `{k}` | `{_cell(v) if isinstance(v, float) else repr(v)}` |" for k, v in rows), ""]


def calibration_report(episodes: DataFrame, calendar: DataFrame, probes: DataFrame, settings: Settings = SETTINGS) -> str:
    """Thresholds, tallies of tagged episodes, the one episode that each probe (label, probe) lies in, and the calendar's coverage.

    A probe that lies in no episode, or in several, is an error.
    """
    tallies = episode_tallies(episodes).persist()
    lines = ["# Calibration", "", "Made from the episodes and the calendar; run again after either changes.", "", "## Thresholds", "", *thresholds(settings)]
    lines += ["## Episodes", "", f"Total: {episodes.count()}", ""]
    for name in ("trigger", "status", "catalyst", "direction", "decade"):
        lines += [f"### By {name}", "", *table(tallies.filter(F.col("dimension") == name).select("value", "n"))]
    tallies.unpersist()
    found = require_one(containing(episodes, probes))
    known = found.join(episodes.select("episode_id", "start_date", "end_date", F.format_string("%.4f", "move_pct").alias("move_pct"), "catalyst"), "episode_id")
    lines += ["## Probes", "", *table(known.select("label", "probe", "episode_id", "start_date", "end_date", "trigger", "move_pct", "catalyst"), ("probe", "label"))]
    lines += ["## Calendar", "", *table(coverage(calendar).select("release", "n", "first", "last", "unscheduled"), ("release",))]
    return "\n".join(lines)


def budget_report(prices: DataFrame, episodes: DataFrame, ledger: DataFrame, model: str, escalation_model: str, escalated: float = 0.2, searches: float = 1.5, settings: Settings = SETTINGS) -> str:
    """What explaining all closed episodes would cost, what it could cost at most, and what has been spent."""
    n = episodes.filter("status = 'closed'").count()
    usd = lambda x: f"${x:.2f}"
    of = lambda k, name: E.estimate(prices.filter(F.col("model") == name), k, searches, settings=settings).first()
    again = round(n * escalated)
    first, second = of(n, model), of(again, escalation_model)
    if first is None or second is None:
        raise ValueError("no price for the models")
    lines = ["# Budget", "", "## Prices", "", *table(prices.select("model", "input_usd", "output_usd"), ("model",)), f"Searches: {usd(settings.search_usd_per_1k)} per 1,000.", ""]
    lines += [
        "## Estimate", "", f"Closed episodes: {n}", f"All of them, {model}: {usd(first.estimate_usd)}", f"{again} of them again, {escalation_model}: {usd(second.estimate_usd)}",
        f"Searches at the cap of {settings.max_searches}: {usd(n * settings.max_searches * settings.search_usd_per_1k / 1000)}", f"Reserve: {usd(n * settings.reserve_usd)}", f"Budget: {usd(settings.budget_usd)}", "",
    ]
    spent = E.ledger_total(ledger).first().total_usd
    runs = ledger.select("run_id", "mode", "model", "episodes_written", "web_search_requests", F.format_string("%.2f", "cost_usd").alias("cost_usd"))
    has = ledger.limit(1).count()
    lines += ["## Spent", "", *(table(runs, ("run_id",)) if has else ["No run so far.", ""]), f"Spent: {usd(spent)}", f"Left: {usd(settings.budget_usd - spent)}", ""]
    return "\n".join(lines)


def enrichment_report(episodes: DataFrame, records: DataFrame, overrides: DataFrame, ledger: DataFrame, secrets: list[str], settings: Settings = SETTINGS) -> str:
    """How far closed episodes are explained, by what, what is left to review, and whether anything leaked.

    records, overrides and ledger are the documents as they are read; secrets are words that none of them may hold.
    """
    current = records.filter(E.is_current(settings)).persist()
    effective = E.apply_overrides(current, overrides, settings).persist()
    missing = missing_records(episodes, current)
    n = lambda d: d.count()
    lines = ["# Enrichment", "", "## Coverage", "", f"Closed episodes: {n(episodes.filter(F.col('status') == 'closed'))}", f"Current records: {n(current)}", f"Missing: {n(missing)}", "", *listing(missing)]
    counted = lambda d, c: table(d.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")))
    lines += ["### Status", "", *counted(current, "status"), "### Status after review", "", *counted(effective, "status")]
    seen = effective.agg(F.count_if("reviewed").alias("reviewed"), F.count_if("rejected").alias("rejected")).first()
    lines += [f"Reviewed: {seen.reviewed}", f"Rejected: {seen.rejected}", "", "### To be reviewed", "", *listing(effective.filter("status = 'needs_review'").select("episode_id"))]
    tallies = record_tallies(current)
    for title, name in (("Models", "model"), ("Dropped sources", "dropped"), ("Stop reasons", "stop")):
        lines += [f"### {title}", "", *table(tallies.filter(F.col("dimension") == name).select("value", "n"))]
    used = search_usage(current).first()
    lines += ["## Searches", "", f"Total: {used.total}", f"Most for one episode: {used.most}", "", "## Spend", "", f"Spent: ${E.ledger_total(ledger).first().total_usd:.2f}", f"Budget: ${settings.budget_usd:.2f}", ""]
    leaked = any(E.leaks(d, secrets).first().leaked for d in (records, overrides, ledger))
    current.unpersist()
    effective.unpersist()
    return "\n".join([*lines, "## Leak scan", "", "FAIL" if leaked else "PASS", ""])


def record_table(records: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each of ids (episode_id): status, confidence, kept sources, drop reasons, searches, cost and headline; missing says that there is no record."""
    d = ids.select("episode_id").distinct().join(records.withColumn("found", F.lit(True)), "episode_id", "left")
    reasons = F.array_join(F.array_sort(F.array_distinct(F.transform("dropped_sources", lambda x: x["reason"]))), ", ")
    return d.select(
        "episode_id", F.coalesce("found", F.lit(False)).alias("found"), "status", "confidence", F.coalesce(F.size("sources"), F.lit(0)).alias("kept_sources"), reasons.alias("dropped_reasons"),
        F.coalesce("usage.web_search_requests", F.lit(0)).alias("searches"), "cost_usd", "headline",
    )
