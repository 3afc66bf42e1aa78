"""Mixing sources to target weights along a time-varying curriculum.

Targets.  Sources in code-point order, null last, take the weights in turn; together they share share x all words.
A target stops at cap x its source's words and the excess goes to the others by weight until none is above: with
sources ordered by cap / weight those that stop are a prefix, found by running sums over one row per source.

Takes.  Each source's documents stand in the order of the md5 of their id and their text's md5.  The mix goes through that stream again
and again until the target is met, so a document is taken whole as often as the target holds the source, and once
more if it lies before the rest; the one on the edge is taken up to the edge.  Offsets are prefix sums in two
levels, of 65,536 md5 ranges within a source and of documents within a range, so that no task holds a source, nor
all rows of equal or null ids.  Sources themselves, one narrow row each, meet in one task.

Positions.  A source's weight over training time 0..1 is a line through knots.  Its integral, scaled to the target,
is the cumulative demand of words; inverted at the offset of a document's copy it gives the time at which that copy
is due.  Sorting by ranges of that time gives the training order.

Null or empty texts have size 0 and are not taken.  Rows of equal id are rows of their own, ordered by their texts'
digests; rows that share both are alike.  A source whose words are 0 has target 0.  An empty table gives an empty table.  Carried columns travel in one struct,
so names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BLANKS, named, written

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
#: Weight over time of each source in turn, as (time, weight) knots from time 0 to 1: rising, even, falling.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 0.75), (1.0, 0.75)))


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), BLANKS), "")).cast("long")


def sized(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, the place in the source's stream (md5, of which the first four digits are the range), and carry as a struct."""
    more = [F.struct(*[named(docs, c) for c in carry]).alias("row")] if carry else []
    doc_id, source, text = (named(docs, c) for c in ("doc_id", "source", "text"))
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text.cast("string"), F.lit("")))))
    return docs.select(
        doc_id.cast("long").alias("doc_id"),
        source.cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("z")).alias("key"),  # orders as the source, null last
        n_words(text).alias("size"),
        digest.alias("place"),
        *more,
    ).withColumn("range", F.substring("place", 1, 4))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """key, source_size -> also turn (from 0) and target.  One row per source."""
    every = Window.partitionBy()
    by_key = Window.orderBy("key")
    numbered = sources.withColumn("turn", F.row_number().over(by_key) - 1)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    d = numbered.withColumn("weight", pick).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    before = Window.orderBy(F.col("most") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    d = d.select(
        "*",
        (F.lit(float(share)) * F.sum("source_size").over(every)).alias("total"),
        F.sum("weight").over(every).alias("all_weight"),
        F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("most_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"),
    )
    d = d.withColumn("full", F.col("most") / F.col("weight") * (F.col("all_weight") - F.col("weight_before")) + F.col("most_before") <= F.col("total"))
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(every), F.lit(0.0))
    gone = F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(every), F.lit(0.0))
    d = d.withColumn("taken_by_full", taken).withColumn("weight_of_full", gone)
    level = (F.col("total") - F.col("taken_by_full")) / (F.col("all_weight") - F.col("weight_of_full"))
    target = F.when(F.col("full"), F.col("most")).otherwise(F.least(F.col("most"), F.col("weight") * level))
    return d.select("key", "source_size", "turn", target.alias("target"))


def due(fraction: Column, turn: Column, schedules=SCHEDULES) -> Column:
    """The time at which the cumulative demand of the source's schedule reaches fraction of its whole."""
    out = None
    for k, knots in enumerate(schedules):
        area, parts = 0.0, []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            parts.append((t0, w0, (w1 - w0) / (t1 - t0), area, area := area + (w0 + w1) / 2 * (t1 - t0)))
        need, time = fraction * F.lit(area), F.lit(1.0)
        for t0, w0, slope, a0, a1 in reversed(parts):
            rest = need - F.lit(a0)
            root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2.0 * slope) * rest))
            time = F.when(need < F.lit(a1), F.lit(t0) + F.lit(2.0) * rest / (F.lit(w0) + root)).otherwise(time)
        out = (F.when(turn % len(schedules) == k, time) if out is None else out.when(turn % len(schedules) == k, time))
    return out


def mix(docs: DataFrame, carry: list[str] | None = None, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, schedules=SCHEDULES) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, whole (whole copies), edge (words of the last, cut copy) and positions (of each copy)."""
    rows = sized(docs, carry)
    if not carry:
        rows = written(rows, "sizes")
    sums = (rows if not carry else written(sized(docs), "sizes")).groupBy("key", "range").agg(F.sum("size").alias("range_size"))
    plan = targets(sums.groupBy("key").agg(F.sum("range_size").alias("source_size")), weights, share, cap)
    earlier = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    running = lambda what, by, order: F.coalesce(F.sum(what).over(earlier(by, order)), F.lit(0))
    sums = sums.withColumn("top", F.substring("range", 1, 2))
    tops = sums.groupBy("key", "top").agg(F.sum("range_size").alias("top_size")).withColumn("top_start", running("top_size", ["key"], "top")).drop("top_size").join(plan, "key")
    ranges = sums.withColumn("range_start", running("range_size", ["key", "top"], "range")).drop("range_size").join(tops, ["key", "top"]).withColumn("range_start", F.col("range_start") + F.col("top_start")).drop("top", "top_start")
    inside = Window.partitionBy("key", "range").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ranges, ["key", "range"])
    d = d.withColumn("start", F.col("range_start") + F.col("inside"))
    d = d.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    rest = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    last = F.least(F.greatest(rest - F.col("start"), F.lit(0)), F.col("size"))
    d = d.withColumn("last", last)
    d = d.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + (F.col("last") > 0).cast("long")).otherwise(0))
    place = lambda k: due((k * F.col("source_size") + F.col("start")) / F.col("target"), F.col("turn"), schedules)
    slots = F.array(*[F.when(F.col("copies") > k, place(F.lit(k))) for k in range(int(cap) + 1)])
    return d.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("last")).alias("taken"),
        F.col("copies"),
        F.when(F.col("last") < F.col("size"), F.col("last")).otherwise(F.lit(0)).alias("edge"),
        F.filter(slots, lambda x: x.isNotNull()).alias("positions"),
        *(["row"] if carry else []),
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space as it stands."""
    ends = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(ends, F.lit(1), n.cast("int")), "")


def training_order(docs: DataFrame, **how) -> DataFrame:
    """docs' columns, a row for each copy the mix takes, in ranges of training time."""
    d = mix(docs, docs.columns, **how)
    d = d.select("row", "edge", F.size("positions").alias("n"), F.posexplode("positions").alias("k", "position"))
    cut = (F.col("edge") > 0) & (F.col("k") == F.col("n") - 1)
    text = F.when(cut, first_words(F.col("row.text"), F.col("edge"))).otherwise(F.col("row.text"))
    columns = [(text if c == "text" else F.when(cut, F.length(text).cast(docs.schema[c].dataType)).otherwise(F.col("row")[c]) if c == "n_chars" else F.col("row")[c]).alias(c) for c in docs.columns]
    return d.orderBy("position", F.col("row.doc_id"), "k").select(*columns)
