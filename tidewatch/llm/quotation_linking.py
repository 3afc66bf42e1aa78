"""Quotation linking: conversations rebuilt from quotes, and told without them.

A line's leading ``>`` signs are its quote level.  Lines end with a line feed, before which a carriage return may stand;
no other character ends a line.  Lines of one level form passages, parted by blank lines; a line that says who wrote what
is quoted below belongs to the quote.  A passage, and each of its lines, is normalised (lower case, single spaces) and
hashed.  Hashes of quoted passages are joined, within a conversation, to the latest earlier message that holds the
passage, or else the line, as its own.  The message that the least nested linked quote comes from, the latest of several,
is the parent.  Parents are followed by doubling, so a reply's first message and depth take rounds in the logarithm of
the longest chain.  Each conversation is told by first message, then turn: every message after its parent, with its own
lines only, as they are written but for blank lines at the text's ends.

The join is as of the quoting turn: a conversation's turns are cut to spans of SPAN, each span of a passage gets the
latest holder before it, and the rest is a running last value inside the span.  So a passage that stands in a third of
all messages is many small windows.  A null or empty text has no lines of its own and no quotes.  Rows without
conversation or turn are told, but link to nothing.  Repeated rows stay, with equal links; messages of one turn
with unlike texts are told apart by a hash of their passages, and later ones follow the one whose quote counts most.  A quote whose original isn't
found, or stands in no earlier turn, links to nothing.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import named, small_batches, written

#: Turns of a conversation that meet in one window.
SPAN = 1024

QUOTE = re.compile(r"(?:[ \t]*>)+")
ATTRIBUTION = re.compile(r"\s*(on|le|am|el)\b.*\b(wrote|écrit|schrieb|escribió)\s*:\s*$|.*\b(wrote|a écrit|schrieb|escribió)\s*:\s*$", re.I)


def parsed(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """Own text, and (level, passage) of every passage in order, level 0 included."""
    rows = []
    for line in re.findall(r"[^\n]*\n|[^\n]+", text or ""):
        m = QUOTE.match(line)
        rows.append((m[0].count(">"), line[m.end() :]) if m else (0, line))
    own, passages, level, held = [], [], None, []

    def close():
        if held:
            passages.append((level, "\n".join(x.removesuffix("\n").removesuffix("\r") for x in held)))
        held.clear()

    following = [next_level for next_level, _ in rows[1:]] + [0]
    for (n, content), after in zip(rows, following):
        names_author = after > n and ATTRIBUTION.match(content)
        if n != level or not content.strip() or names_author:
            close()
            level = n
        if names_author:
            continue
        if n == 0:
            own.append(content)
        if content.strip():
            held.append(content)
    close()
    return "".join(own).strip("\r\n"), passages


def mark(passage: str) -> str:
    return hashlib.md5(" ".join(passage.lower().split()).encode()).hexdigest()


def units(passages: list[tuple[int, str]]) -> list[tuple[int, int, str]]:
    """(level, 0 for a passage or 1 for one of its lines, hash)."""
    out = []
    for level, passage in passages:
        out.append((level, 0, mark(passage)))
        lines = passage.split("\n")
        if len(lines) > 1:
            out += [(level, 1, mark(x)) for x in lines]
    return out


def latest_holders(each: DataFrame, span: int = SPAN) -> DataFrame:
    """conv_id, turn, row, level, kind, hash of units -> conv_id, turn, row, hash, where, whole, original: quotes with the latest earlier turn that holds them."""
    at = F.floor(F.col("turn") / span)
    # a message's quotes of a passage are one row, and so are all own lines of a turn
    own = F.col("level") == 0
    rows = each.groupBy("conv_id", "hash", "turn", F.when(~own, F.col("row")).alias("row"), own.alias("own")).agg(F.min(F.struct("level", "kind")).alias("where"), F.max((F.col("kind") == 0).cast("int")).alias("whole"))
    rows = rows.withColumn("span", at)
    last = rows.filter("own").groupBy("conv_id", "hash", "span").agg(F.max("turn").alias("last"))
    spans = rows.filter("NOT own").select("conv_id", "hash", "span").distinct().join(last, ["conv_id", "hash", "span"], "full")
    before = Window.partitionBy("conv_id", "hash").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    brought = spans.withColumn("turn", F.max("last").over(before)).filter("turn IS NOT NULL").select("conv_id", "hash", "turn", F.lit(None).cast("long").alias("row"), F.lit(True).alias("own"), F.lit(None).cast(rows.schema["where"].dataType).alias("where"), F.lit(0).alias("whole"), "span")
    earlier = Window.partitionBy("conv_id", "hash", "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    met = rows.unionByName(brought).withColumn("original", F.max(F.when(F.col("own"), F.col("turn"))).over(earlier))
    return met.filter("NOT own AND original IS NOT NULL").select("conv_id", "turn", "row", "hash", "where", "whole", "original")


def link(messages: DataFrame, carry: tuple[str, ...] = ("role",)) -> DataFrame:
    """messages (conv_id, turn, text, carry) -> conv_id, turn, carry, own_text, n_quoted (passages), n_linked, parent_turn, root_turn, depth."""

    def run(batches):
        import pyarrow as pa

        unit = pa.list_(pa.struct([("level", pa.int32()), ("kind", pa.int32()), ("hash", pa.string())]))
        for batch in batches:
            own, found = zip(*(parsed(t.as_py()) for t in batch.column(3))) if batch.num_rows else ((), ())
            quoted = [[dict(zip(("level", "kind", "hash"), u)) for u in units(p)] for p in found]
            n = [sum(level > 0 for level, _ in p) for p in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(own, pa.string()), pa.array(quoted, unit), pa.array(n, pa.int64())], ["conv_id", "turn", "more", "own_text", "units", "n_quoted"])

    small_batches(messages.sparkSession)
    more = F.struct(*[named(messages, c).alias(c) for c in carry])
    rows = messages.select(messages["conv_id"].cast("long").alias("conv_id"), messages["turn"].cast("long").alias("turn"), more.alias("more"), messages["text"].cast("string").alias("text"))
    out = T._parse_datatype_string("conv_id long, turn long, own_text string, units array<struct<level:int,kind:int,hash:string>>, n_quoted long").fields
    told = written(rows.mapInArrow(run, T.StructType([*out[:2], rows.schema["more"], *out[2:]])).withColumn("row", F.xxhash64("units")), "parsed")
    each = told.select("conv_id", "turn", "row", F.explode("units").alias("u")).select("conv_id", "turn", "row", "u.*").filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    linked = latest_holders(each)
    best = F.min_by("original", F.struct("where.level", "where.kind", -F.col("original"))).alias("parent_turn")
    place = F.min(F.struct("where.level", "where.kind", -F.col("original"))).alias("place")
    parents = written(linked.groupBy("conv_id", "turn", "row").agg(best, place, F.sum("whole").alias("n_linked")), "parents")
    # (turn, up, steps): up is an ancestor, steps away; doubled until every up has no parent.  Turns leave the rounds when
    # they have arrived, and are still there to be looked up.  Of messages of one turn the quote that counts most is followed
    turns = parents.groupBy("conv_id", "turn").agg(F.min_by("parent_turn", "place").alias("up"))
    active, arrived = turns.withColumn("steps", F.lit(1).cast("long")), []
    while True:
        chain = active
        for done in arrived:
            chain = chain.unionByName(done)
        above = chain.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("far"), F.col("steps").alias("more"))
        d = written(active.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("far", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("far").isNotNull().alias("moved")), "chain")
        arrived.append(d.filter("NOT moved").drop("moved"))
        active = d.filter("moved").drop("moved")
        if not active.limit(1).count():
            break
    chain = arrived[0]
    for done in arrived[1:]:
        chain = chain.unionByName(done)
    above = chain.select("conv_id", F.col("turn").alias("parent_turn"), "up", "steps")
    links = parents.join(above, ["conv_id", "parent_turn"], "left").select("conv_id", "turn", "row", "n_linked", "parent_turn", F.coalesce("up", "parent_turn").alias("up"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    out = told.join(links, ["conv_id", "turn", "row"], "left")
    return out.select(
        "conv_id", "turn", *[F.col("more").getField(c).alias(c) for c in carry], "own_text", "n_quoted",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "parent_turn", F.coalesce("up", "turn").alias("root_turn"), F.coalesce("steps", F.lit(0)).cast("long").alias("depth"),
    )


def conversations(messages: DataFrame, carry: tuple[str, ...] = ("role",)) -> DataFrame:
    """link(), in the order in which the conversations are told."""
    return link(messages, carry).orderBy("conv_id", "root_turn", "turn")


def as_mail(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a chat written as mail: each turn quotes the one before, and in it the one before that; of a repeated turn the smallest text."""
    one = turns.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    before = lambda n: one.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("text").alias(f"t{n}"))
    quoted = lambda c, sign: F.regexp_replace(F.col(c), r"(?md)^", sign)
    d = turns.join(before(1), ["conv_id", "turn"], "left").join(before(2), ["conv_id", "turn"], "left")
    deep = F.concat(F.lit("> Someone wrote:\n"), quoted("t2", "> > "), F.lit("\n"))
    quote = F.concat(F.lit("Someone wrote:\n"), F.coalesce(deep, F.lit("")), quoted("t1", "> "), F.lit("\n\n"))
    return d.select("conv_id", "turn", "role", F.concat(F.coalesce(quote, F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))
