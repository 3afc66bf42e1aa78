"""URL filters whose lists change: a capture is judged by the entries active when it was fetched.

An entry (pattern, since, action) holds for a host and all below it from its date until the next entry of the same
pattern.  Actions are block, allow and drop; a drop ends the entry before it.  Of the patterns with an active entry the
longest decides.  Entries become intervals per pattern, then, for every host captured, a timeline of intervals that
don't overlap, each with its decision: one running last value for each length of pattern.  Captures join their host's
timeline as of their time, so a capture meets one interval at most.  A host with more than one in PARTS of all captures
is dealt to as many groups as it has such shares, each with a copy of its timeline; there are PARTS such hosts at most,
which bounds what is broadcast.  Only hosts, not captures, are paired with patterns.

A null, empty or unreadable URL has no host and is not kept; a null time meets no entry.  Of entries with equal pattern
and time the one first in the order block, allow, drop counts.  Entries without pattern, time or known action, and
captures' other columns, play no part.  Hosts in letters beyond ASCII and their xn-- forms are not the same here.  An empty list keeps every capture that has a host; repeated captures are judged
alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import named

ACTIONS = ("block", "allow", "drop")
#: A group of one host's captures holds about one in PARTS of all captures at most.
PARTS = 1024
#: Scheme, user if any, host: nothing else of a URL has to be well-formed.
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)"
#: White space and controls at a URL's ends, and tabs and line ends anywhere in it, are no part of it.
OUTSIDE, INSIDE = r"^[\x00-\x20]+|[\x00-\x20]+$", r"[\t\n\r]"


def host_of(url: Column) -> Column:
    """Lower-case host without final dot; null if there is none.

    As browsers read it: a backslash is a slash, and signs written with % are the signs that they stand for.
    """
    plain = F.regexp_replace(F.regexp_replace(url, OUTSIDE, ""), INSIDE, "")
    raw = F.regexp_extract(F.translate(plain, "\\", "/"), HOST, 1)
    read = F.when(raw.contains("%"), F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)).otherwise(raw)
    host = F.rtrim(F.lower(F.regexp_replace(read, OUTSIDE, "")), F.lit("."))
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, since, until (null: still), action, for block and allow."""
    known = entries.select(host_of(F.concat(F.lit("//"), F.regexp_replace(entries["pattern"], OUTSIDE, ""))).alias("pattern"), entries["since"].alias("since"), entries["action"].alias("action"))
    known = known.filter(F.col("pattern").isNotNull() & (F.col("pattern") != "") & F.col("since").isNotNull() & F.col("action").isin(*ACTIONS))
    turn = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    one = known.groupBy("pattern", "since").agg(F.min_by("action", turn).alias("action"))
    until = F.lead("since").over(Window.partitionBy("pattern").orderBy("since"))
    return one.withColumn("until", until).filter("action <> 'drop'").select("pattern", "since", "until", "action")


def timelines(hosts: DataFrame, entries: DataFrame) -> DataFrame:
    """host -> host, since, until, pattern, action: every host's decisions, one after the other; null actions between them."""
    spans = intervals(entries).withColumn("labels", F.size(F.split("pattern", r"\.")))
    longest = spans.agg(F.max("labels")).first()[0] or 0  # of the list; a host has 127 labels at most
    labels = F.split("host", r"\.")
    first = F.explode(F.sequence(F.greatest(F.lit(1), F.size(labels) - longest + 1), F.size(labels)))
    suffixes = hosts.select("host", first.alias("k")).select("host", F.array_join(F.slice(F.split("host", r"\."), F.col("k"), F.size(F.split("host", r"\."))), ".").alias("pattern"))
    met = suffixes.join(spans, "pattern")
    state = lambda on: F.struct(F.lit(on).alias("on"), "pattern", "action")
    starts = met.select("host", F.col("since").alias("at"), "labels", state(True).alias("state"))
    ends = met.filter("until IS NOT NULL").select("host", F.col("until").alias("at"), "labels", state(False).alias("state"))
    # a pattern's end and its next start may fall together: the start counts
    events = starts.unionByName(ends).groupBy("host", "at", "labels").agg(F.max("state").alias("state"))
    run = Window.partitionBy("host").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    now = [F.last(F.when(F.col("labels") == n, F.col("state")), ignorenulls=True).over(run).alias(f"s{n}") for n in range(1, longest + 1)]
    best = F.coalesce(*[F.when(F.col(f"s{n}.on"), F.col(f"s{n}")) for n in range(longest, 0, -1)]) if longest else F.lit(None).cast("struct<on:boolean,pattern:string,action:string>")
    known = events.select("host", "at", *now).distinct().select("host", "at", best.alias("s"))
    until = F.lead("at").over(Window.partitionBy("host").orderBy("at"))
    return known.select("host", F.col("at").alias("since"), until.alias("until"), "s.pattern", "s.action")


def judge(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, time_col: str) -> DataFrame:
    """id_col, host, fetched, pattern, action, since (of the entry's interval) and kept, per capture."""
    c = captures.select(named(captures, id_col).alias(id_col), host_of(named(captures, url_col)).alias("host"), named(captures, time_col).alias("fetched"), F.xxhash64(named(captures, id_col), named(captures, url_col), named(captures, time_col)).alias("_mark"))
    share = max(1, -(-captures.count() // PARTS))
    hot = c.filter("host IS NOT NULL").groupBy("host").count().filter(F.col("count") > share).select("host", F.ceil(F.col("count") / share).cast("int").alias("_k"))  # PARTS rows at most
    line = timelines(c.select("host").filter("host IS NOT NULL").distinct(), entries).filter("action IS NOT NULL")
    line = line.join(F.broadcast(hot), "host", "left").withColumn("listed_part", F.explode(F.sequence(F.lit(0), F.coalesce("_k", F.lit(1)) - 1))).drop("_k").withColumnRenamed("host", "listed")
    c = c.join(F.broadcast(hot), "host", "left").withColumn("_part", F.pmod(F.col("_mark"), F.coalesce("_k", F.lit(1))).cast("int"))
    asof = (F.col("host") == F.col("listed")) & (F.col("_part") == F.col("listed_part")) & (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    d = c.join(line, asof, "left")
    kept = F.col("host").isNotNull() & ~F.coalesce(F.col("action") == "block", F.lit(False))
    return d.select(id_col, "host", "fetched", "pattern", "action", "since", kept.alias("kept"))
