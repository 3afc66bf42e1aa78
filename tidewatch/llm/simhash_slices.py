"""SimHash fingerprints and their near-duplicate groups by bit-sliced comparison.

A fingerprint has 64 bits; bit b is 1 if more than half of the shingles' XXH64 values (seed 42) have it.  Two
fingerprints are linked if at most RADIUS = 2 bits differ, and linked documents form groups.

Equal fingerprints are one node, so copies are never paired.  Of four 16-bit blocks two linked fingerprints share
at least two, so each of the six pairs of blocks is a table whose 32-bit keys collect the candidates; the other 32
bits are compared.  Inside a collection the bits stand vertically: one 64-bit word for each bit of 64 fingerprints.
A query's bit, spread over a word, is XORed with such a word, carry-save counters of two bits add up 64 distances at
a time, and a block is abandoned once every one of its distances exceeds the radius.  A collection larger than CHUNK
is dealt to chunks by hash and every pair of chunks is compared by a task of its own, so none is too large for one
task and no pair is lost.  A task returns a link from each node to the smallest node of its group there, not all pairs.

A null or empty text, or one without words, has fingerprint zero and is linked like any other.  Rows of equal doc_id
are rows of their own; the id of a group is its smallest non-null doc_id (null if it has none).  An empty table
gives an empty table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import named, small_batches, whole_rows, written

RADIUS, SHINGLE, SEED = 2, 3, 42
#: Fingerprints of a collection that are compared in one task.
CHUNK = 2048
#: Pairs of a query and a block of 64 that are compared at a time.
PAIRS = 1 << 16
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64 bits."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z alone are lowered, ASCII white space alone splits
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return h(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(words) - size]))
    n, ones = len(starts), np.zeros(64, np.int64)
    for k in range(0, n, 1 << 14):
        part = [h(joined[i:j], seed) for i, j in zip(starts[k : k + (1 << 14)].tolist(), (ends[size - 1 + k : size - 1 + k + (1 << 14)] - 1).tolist())]
        ones += np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) per row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(named(docs, "doc_id").cast("long").alias("doc_id"), named(docs, "text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def slices(values: np.ndarray, bits: int) -> np.ndarray:
    """bits x blocks: word [b, k] holds bit b of values 64k to 64k + 63, the first in its lowest bit."""
    blocks = -(-len(values) // 64)
    padded = np.zeros(blocks * 64, values.dtype)
    padded[: len(values)] = values
    return np.stack([np.packbits((padded >> values.dtype.type(b)) & values.dtype.type(1), bitorder="little").view("<u8") for b in range(bits)])


def within(values: np.ndarray, bits: int, lo: np.ndarray, hi: np.ndarray, radius: int = RADIUS):
    """Yield arrays (i, j), lo[i] <= j < hi[i], of values at most radius bits apart."""
    planes = slices(values, bits)
    first, blocks = lo // 64, np.where(hi > lo, -(-hi // 64) - lo // 64, 0)
    ends = np.cumsum(blocks)
    total, goal = int(ends[-1]) if len(ends) else 0, radius + 1
    width = goal.bit_length()
    for at in range(0, total, PAIRS):
        pair = np.arange(at, min(at + PAIRS, total))
        q = np.searchsorted(ends, pair, "right")
        block = first[q] + pair - (ends[q] - blocks[q])
        dead = _outside(lo[q] - block * 64, hi[q] - block * 64)
        counters = [np.zeros(len(q), np.uint64) for _ in range(width)]
        for b in range(bits):
            spread = np.where((values[q] >> values.dtype.type(b)) & values.dtype.type(1), FULL, np.uint64(0))
            carry = planes[b][block] ^ spread
            for c in counters:
                carry, c[:] = c & carry, c ^ carry
            over = np.full(len(q), FULL)
            for k, c in enumerate(counters):
                over &= c if goal >> k & 1 else ~c
            dead |= over
            if b % 4 == 3 and b + 1 < bits:
                live = dead != FULL
                if not live.all():
                    q, block, dead, counters = q[live], block[live], dead[live], [c[live] for c in counters]
                    if not len(q):
                        break
        if len(q):
            left = np.unpackbits((~dead).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(left)
            if len(row):
                yield q[row], block[row] * 64 + lane


def _outside(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Words whose bits from lo to hi - 1 are 0 and the others 1."""
    one = np.uint64(1)
    low = (one << np.clip(lo, 0, 63).astype(np.uint64)) - one
    high = np.where(hi >= 64, np.uint64(0), ~((one << np.clip(hi, 0, 63).astype(np.uint64)) - one))
    return low | high


def roots_of(n: int, links) -> np.ndarray:
    """The smallest member of each of 0..n-1's group under the links."""
    root = np.arange(n)
    for i, j in links:
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _linked(batches):
    """Batches of (key columns, side, fp, rest) sorted by those -> links (u, v) between the fingerprints of a collection."""
    import pyarrow as pa

    def compare(t):
        key, side, fp, rest = t
        starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1))))
        ends = np.concatenate((starts[1:], [len(fp)]))
        group = np.repeat(np.arange(len(starts)), ends - starts)
        both = (key[:, 2] != key[:, 3])  # of two chunks: the first's rows against the second's
        turn = np.full(len(starts), 0)
        np.add.at(turn, group, side == 0)
        lo = np.where(both, starts[group] + turn[group], np.arange(len(fp)) + 1)
        hi = np.where(both & (side == 1), 0, ends[group])
        root = roots_of(len(fp), within(rest, 32, lo, hi))
        apart = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[apart]), pa.array(fp[root[apart]])], ["u", "v"])

    held = None
    for batch in batches:
        c = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
        t = (np.stack(c[:4], 1), c[4], c[5], c[6].astype(np.uint32))
        if held is not None:
            t = tuple(np.concatenate((a, b)) for a, b in zip(held, t))
        if not len(t[1]):
            continue
        last = np.flatnonzero((t[0] != t[0][-1]).any(1))  # the last collection may go on in the next batch
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield compare(tuple(x[:cut] for x in t))
        held = tuple(x[cut:] for x in t)
    if held is not None and len(held[1]):
        yield compare(held)


def candidates(nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """nodes (fp) -> tab, key, a, b, side, fp, rest: collections of at most about two chunks, all pairs of which are to be compared."""
    block = lambda k: F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))
    tables = []
    for t, (i, j) in enumerate(combinations(range(4), 2)):
        x, y = (k for k in range(4) if k not in (i, j))
        tables.append(F.struct(F.lit(t).cast("long").alias("tab"), (block(i) * 65536 + block(j)).alias("key"), (block(x) * 65536 + block(y)).alias("rest")))
    rows = nodes.select("fp", F.explode(F.array(*tables)).alias("t")).select("fp", "t.*")
    sizes = rows.groupBy("tab", "key").agg(F.count("*").alias("n")).filter("n > 1")
    d = rows.join(sizes, ["tab", "key"]).withColumn("k", F.ceil(F.col("n") / chunk).cast("long"))
    d = d.withColumn("own", F.when(F.col("k") > 1, F.pmod(F.xxhash64("fp", "tab"), F.col("k"))).otherwise(F.lit(0)).cast("long"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    return d.select("tab", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("long").alias("side"), "fp", "rest")


def links(nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """nodes (fp, distinct) -> u, v: links that connect exactly what links of at most RADIUS bits connect."""
    key = ["tab", "key", "a", "b"]
    dealt = candidates(nodes, chunk).repartition(*key).sortWithinPartitions(*key, "side", "fp")
    return dealt.mapInArrow(_linked, "u long, v long")


def groups(fps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of doc_id and fp, in files -> fp, root (one for each group), component_id per fingerprint."""
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = written(components(links(nodes.select("fp"), chunk)), "roots")
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return written(rooted.join(least, "root").select("fp", "root", "component_id"), "named")


def near_duplicates(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, fp, component_id per row of docs."""
    small_batches(docs.sparkSession)
    rows = written(fingerprints(docs), "fingerprints")
    return rows.join(groups(rows, chunk).drop("root"), "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row of each group, columns as they are: the one of smallest doc_id, null last, then of smallest text hash, then of smallest hash of the other columns.

    A row is known by these three, so that only its key and fingerprint are written on the way, and the rows themselves
    move once, to meet the keys that stay.  Rows that share all three are alike, and one of them stays.
    """
    small_batches(docs.sparkSession)
    others = [named(docs, f.name) for f in docs.schema.fields if f.name != "text" and "map<" not in f.dataType.simpleString()]
    doc_id, text = named(docs, "doc_id").cast("long"), named(docs, "text").cast("string")
    key = [doc_id.isNull().alias("_null"), F.coalesce(doc_id, F.lit(0)).alias("_id"), F.xxhash64(text).alias("_text"), F.xxhash64(*others).alias("_rest")]
    names = ["_null", "_id", "_text", "_rest"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(4)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(fps)], [*names, "fp"])

    marked = docs.select(*key, text.alias("text")).mapInArrow(run, "_null boolean, _id long, _text long, _rest long, fp long")
    rows = written(marked, "fingerprints")
    of_fp = rows.groupBy("fp").agg(F.min(F.struct(*names)).alias("first"))
    ids = rows.select("fp", F.when(~F.col("_null"), F.col("_id")).alias("doc_id"))
    keep = of_fp.join(groups(ids, chunk), "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    keyed = docs.select(*key, whole_rows(docs).alias("row"))
    return keyed.join(written(keep, "kept"), names, "left_semi").dropDuplicates(names).select("row.*")
