"""Macro calendar: parsing, merging, validating, and tagging of episodes with the releases in their search windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import month_number, plain_text, safe_url
from ..settings import SETTINGS, Settings
from .ranges import interval_places, point_places

COLUMNS = ("date", "release", "release_type", "scheduled", "source_url")
KEY = ("date", "release", "release_type")

#: Where a piece of a page's text starts: a word that a number follows, as a month does its day.
PIECE = r"(?<=[^A-Za-z/])(?=[A-Za-z]+(?:/[A-Za-z]+)? \d)"
#: Words of the pages.  Fixed values.
SECTION, AFTER_ENTRY, CALL, MEETING = "FOMC Meetings", "Statement", "Conference Call", "Meeting"


def _rows(dated: DataFrame, unscheduled: Column, release: str) -> DataFrame:
    kind = F.when(unscheduled, "unscheduled").otherwise("meeting")
    return dated.select("date", F.lit(release).alias("release"), kind.alias("release_type"), (~unscheduled).alias("scheduled"), "source_url")


def _pieces(text: Column) -> Column:
    """The text cut at every word that a number follows, without what comes before the first."""
    parts = F.split(F.concat(F.lit(" "), text), PIECE)
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def _read(pieces: DataFrame) -> DataFrame:
    """piece -> month (its last name), day (the last), note (in brackets, or empty) and rest (what follows).

    A piece whose second word is no day or pair of days, with a star or without, is no entry and goes.
    """
    words = F.split(F.trim("piece"), " ", 3)
    d = pieces.withColumn("w", words).withColumn("days", F.rtrim(F.col("w")[1], F.lit("*"))).filter(F.col("days").rlike(r"^\d{1,2}(-\d{1,2})?$"))
    tail = F.concat(F.when(F.col("w")[1].endswith("*"), "*").otherwise(""), F.coalesce(F.get("w", F.lit(2)), F.lit("")))
    d = d.withColumn("tail", tail).withColumn("noted", F.ltrim("tail", F.lit("* ")).startswith("("))
    note = F.when(F.col("noted"), F.substring_index(F.substring_index("tail", ")", 1), "(", -1)).otherwise("")
    rest = F.when(F.col("noted"), F.expr("substr(tail, instr(tail, ')') + 1)")).otherwise(F.col("tail"))
    names, days = F.split(F.col("w")[0], "/"), F.split("days", "-")
    return d.withColumns({"month": F.element_at(names, -1), "day": F.element_at(days, -1).cast("int"), "note": note, "rest": F.trim(rest)}).drop("w", "days", "tail", "noted", "piece")


def _date(year: Column) -> Column:
    month = F.coalesce(month_number(F.col("month")), F.raise_error(F.concat(F.lit("unknown month: "), F.col("month"))).cast("int"))
    return F.make_date(year, month, "day")


def parse_year_pages(pages: DataFrame, skip: tuple[str, ...] = (), release: str = SETTINGS.policy_release) -> DataFrame:
    """pages (html, year, source_url) of past years -> calendar rows.  Cancelled meetings and dates of skip are left out.

    An entry is a month, a day or two, a note in brackets if any, what it was, a dash and the year.  A conference call
    or an unscheduled note makes a row unscheduled; an entry counts on its last day.
    """
    d = _read(pages.select("year", "source_url", F.explode(_pieces(plain_text(F.col("html")))).alias("piece")))
    of_year = F.split("rest", r" ?- ?(?=\d{4})", 2)
    d = d.withColumn("what", of_year[0]).filter(F.col("what").isin(CALL, MEETING) & (F.substring(F.get(of_year, F.lit(1)), 1, 4) == F.col("year").cast("string")) & (F.col("note") != "cancelled"))
    d = d.withColumn("date", _date(F.col("year")))
    if skip:
        d = d.filter(~F.col("date").cast("string").isin(*skip))
    return _rows(d, (F.col("what") == CALL) | (F.col("note") == "unscheduled"), release)


def parse_current_page(pages: DataFrame, release: str = SETTINGS.policy_release) -> DataFrame:
    """pages (html, source_url) with a section for each year -> calendar rows.  Notation votes are left out.

    An entry is a month or two, a day or two, a note in brackets if any, and then a star, the statement, the next entry
    or the end.  Of a meeting over the end of a month, the second month counts.
    """
    sections = F.split(plain_text(F.col("html")), rf"(?=\b\d{{4}} {SECTION})")
    each = pages.select("source_url", F.explode(sections).alias("section")).filter(F.col("section").rlike(rf"^\d{{4}} {SECTION}"))
    each = each.select("source_url", F.substring("section", 1, 4).cast("int").alias("year"), F.explode(_pieces(F.substring_index("section", SECTION, -1))).alias("piece"))
    d = _read(each).filter((F.col("rest") == "") | F.col("rest").startswith("*") | F.col("rest").startswith(AFTER_ENTRY))
    d = d.filter(~F.col("note").contains("notation vote")).withColumn("date", _date(F.col("year")))
    return _rows(d, F.col("note").contains("unscheduled"), release)


RELEASE_DATES = "count int, offset int, limit int, release_dates array<struct<release_id:int,date:string>>"


def parse_release_dates(payloads: DataFrame, url_template: str = "https://alfred.stlouisfed.org/releases/calendar?rid={rid}&y={year}") -> DataFrame:
    """payloads (json, release, release_type) -> calendar rows.  Raises where the answer was cut short or holds a bad date."""
    j = payloads.select("release", "release_type", F.from_json("json", RELEASE_DATES).alias("j"))
    cut = F.when(F.col("j.count") > F.size("j.release_dates"), F.raise_error(F.lit("the answer was cut into pages")).cast("boolean")).otherwise(True)
    each = j.filter(cut).select("release", "release_type", F.inline("j.release_dates"))
    day = F.coalesce(F.try_to_date("date", "yyyy-MM-dd"), F.raise_error(F.concat(F.lit("bad date: "), F.col("date"))).cast("date"))
    url = F.replace(F.replace(F.lit(url_template), F.lit("{rid}"), F.col("release_id").cast("string")), F.lit("{year}"), F.year("day").cast("string"))
    return each.withColumn("day", day).select(F.col("day").alias("date"), "release", "release_type", F.lit(True).alias("scheduled"), url.alias("source_url"))


def require_parsed(rows: DataFrame, what: str) -> DataFrame:
    if not rows.limit(1).count():
        raise ValueError(f"no rows parsed from {what}")
    return rows


def drop_listed(calendar: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) by listed (release, date): days on which data came out but not the release."""
    return calendar.join(listed, ["release", "date"], "left_anti"), calendar.join(listed, ["release", "date"], "left_semi")


def trim(calendar: DataFrame, today: str, settings: Settings = SETTINGS) -> DataFrame:
    return calendar.filter(F.col("date").between(F.lit(settings.calendar_start).cast("date"), F.date_add(F.lit(today).cast("date"), settings.calendar_horizon_days)))


def latest(rows: DataFrame, arrival: str = "arrival") -> DataFrame:
    """One row per key, the last to arrive."""
    return rows.groupBy(*KEY).agg(F.max_by(F.struct("scheduled", "source_url"), arrival).alias("x")).select(*KEY, "x.*")


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """change (removed or added) and the four columns that make a row what it is."""
    cols = [*KEY, "scheduled"]
    a, b = old.select(*cols).distinct(), new.select(*cols).distinct()
    gone, come = a.join(b, cols, "left_anti"), b.join(a, cols, "left_anti")
    return gone.withColumn("change", F.lit("removed")).unionByName(come.withColumn("change", F.lit("added")))


def change_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """change, n: how many rows a new calendar removes and adds; both are told, also if none."""
    n = differences(old, new).agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("removed", "added")])
    return n.select(F.inline(F.array(*[F.struct(F.lit(c).alias("change"), F.col(c).alias("n")) for c in ("removed", "added")])))


def forbidden_changes(old: DataFrame, fresh: DataFrame, today: str) -> DataFrame:
    """Changes before today that a merge must not make: any removal, and an addition that was scheduled."""
    return differences(old, fresh).filter((F.col("date") < F.lit(today).cast("date")) & ((F.col("change") == "removed") | F.col("scheduled")))


def sound(rows: DataFrame) -> DataFrame:
    """One row per key, in order of date, release and type: the last to arrive where rows tell (arrival), else the one whose other columns come last."""
    order = F.struct(*[c for c in ("arrival", "scheduled", "source_url") if c in rows.columns])
    one = rows.groupBy(*KEY).agg(F.max_by(F.struct("scheduled", "source_url"), order).alias("x"))
    return one.select(*KEY, "x.*").orderBy(*KEY)


def merge(old: DataFrame | None, fresh: DataFrame, today: str, accept: bool = False) -> DataFrame:
    """The next calendar: fresh without repeated keys and in order, once its past has been held against old's.

    ValueError if the past was rewritten and accept is false.
    """
    fresh = sound(fresh)
    if old is not None and not accept:
        bad = forbidden_changes(old, fresh, today).orderBy(*KEY).limit(10).collect()
        if bad:
            raise ValueError("the past has changed: " + "; ".join(f"{r.change} {r.date} {r.release}" for r in bad))
    return fresh


def violations(calendar: DataFrame, today: str, settings: Settings = SETTINGS) -> DataFrame:
    """check, detail of every structural defect; empty for a sound calendar."""
    t = F.lit(today).cast("date")
    monthly = calendar.filter(F.col("release").isin(*settings.monthly_releases))
    per_month = monthly.groupBy("release", F.date_format("date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n")).filter("n > 1")
    allowed = F.struct("release", "month").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in settings.double_months]) if settings.double_months else F.lit(False)
    first = monthly.groupBy("release").agg(F.min("date").alias("first")).filter(F.col("first") > F.lit(settings.first_release_by).cast("date"))
    labels = [(settings.policy_release, *settings.policy_per_year), *[(r, *settings.monthly_per_year) for r in settings.monthly_releases]]
    spine = calendar.sparkSession.range(1).select(F.explode(F.sequence(F.lit(int(settings.calendar_start[:4])), F.year(t) - 1)).alias("year"))
    spine = spine.select("year", F.inline(F.array(*[F.struct(F.lit(r).alias("release"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for r, a, b in labels])))
    counted = calendar.filter((F.col("release") != settings.policy_release) | F.col("scheduled")).groupBy(F.year("date").alias("year"), "release").agg(F.count("*").alias("n"))
    yearly = spine.join(counted, ["year", "release"], "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(~F.col("n").between(F.col("lo"), F.col("hi")))
    said = lambda check, *cols: (F.lit(check).alias("check"), F.concat_ws(" ", *cols).alias("detail"))
    horizon = F.date_add(t, settings.calendar_horizon_days)
    parts = [
        calendar.filter("date IS NULL").select(*said("null date", "release")),
        calendar.groupBy(*KEY).count().filter("count > 1").select(*said("duplicate", F.col("date").cast("string"), "release", "release_type")),
        calendar.filter(~F.coalesce(safe_url(F.col("source_url")), F.lit(False))).select(*said("url", F.col("date").cast("string"), "release")),
        calendar.filter((F.col("date") < F.lit(settings.calendar_start).cast("date")) | (F.col("date") > horizon)).select(*said("range", F.col("date").cast("string"), "release")),
        per_month.filter(~allowed).select(*said("month", "release", "month", F.col("n").cast("string"))),
        first.select(*said("first", "release", F.col("first").cast("string"))),
        yearly.select(*said("year", F.col("year").cast("string"), "release", F.col("n").cast("string"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validate(calendar: DataFrame, today: str, settings: Settings = SETTINGS) -> None:
    found = violations(calendar, today, settings).limit(10).collect()
    if found:
        raise ValueError("; ".join(f"{r.check}: {r.detail}" for r in found))


def tag(episodes: DataFrame, calendar: DataFrame) -> DataFrame:
    """Episodes with scheduled_releases and unscheduled_releases ("release date", by date) and catalyst.

    A window lies in one or two buckets of its length, in which releases are looked up (see ranges); no side need be small,
    and what is gathered again follows the episodes and their releases.  Episodes are read once, and every one stays.
    """
    windows = episodes.withColumn("_at", F.explode_outer(interval_places(F.col("search_from"), F.col("search_to"))))
    label = F.concat_ws(" ", "release", F.col("date").cast("string"))
    release = calendar.select(F.explode(point_places(F.col("date"))).alias("_there"), F.col("date").alias("_day"), "scheduled", F.struct("date", "release", "release_type", label.alias("label")).alias("x"))
    held = (F.col("_at") == F.col("_there")) & F.col("_day").between(F.col("search_from"), F.col("search_to"))
    one_kind = lambda on: F.transform(F.array_sort(F.collect_list(F.when(F.col("scheduled") == on, F.col("x")))), lambda x: x["label"])
    out = windows.join(release, held, "left").groupBy(*episodes.columns).agg(one_kind(True).alias("scheduled_releases"), one_kind(False).alias("unscheduled_releases"))
    return out.withColumn("catalyst", F.when(F.size("scheduled_releases") > 0, "scheduled").otherwise("surprise"))


def uncovered(episodes: DataFrame, calendar: DataFrame, releases: tuple[str, ...]) -> DataFrame:
    """release, last, through: releases whose last date is before the last search window's end."""
    spark = calendar.sparkSession
    names = spark.createDataFrame([(r,) for r in releases], "release string")
    last = names.join(calendar.groupBy("release").agg(F.max("date").alias("last")), "release", "left")
    through = episodes.agg(F.max("search_to").alias("through"))  # one row
    return last.join(through, F.col("last").isNull() | (F.col("last") < F.col("through"))).filter("through IS NOT NULL")


def coverage(calendar: DataFrame) -> DataFrame:
    return calendar.groupBy("release").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.count_if(~F.col("scheduled")).alias("unscheduled"))
