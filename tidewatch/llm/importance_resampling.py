"""Importance resampling towards a target distribution over hashed features.

Features are all runs of 1 to max_n consecutive words, hashed to buckets.  The document-by-bucket counts are kept as
a sparse matrix in blocks of compressed rows: a block holds the ids of its documents, where each one's entries begin,
and the entries' buckets and counts.  Column sums of all blocks give the two distributions, the corpus' and the
target's; a bucket's gain is the floored logarithm of their smoothed ratio.  The product of every block with the
vector of gains gives the documents' weights; with Gumbel noise from a hash of the id, the highest scores are a
sample without replacement in proportion to the weights' exponentials.

Sums are at most n_buckets numbers, a bound that is a parameter; so only they meet on the driver.  Ranks come from one
sort by ranges of score, and offsets of the ranges.

A null text has no words; a document without features has weight 0.  Rows of equal id are rows of their own with the same
noise, ranked by their score, then by where they stand in the matrix; a null id comes after all others of its score
and takes its noise from an empty id.  Empty tables give an empty table, an empty target sums of 0.  Only the columns
named are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import named, small_batches, written

#: A block ends when it has so many documents or entries.
BLOCK_DOCS, BLOCK_ENTRIES = 1024, 1 << 16
#: Blocks in a row group of the stored matrix, which a reader holds decoded at once: 8 MB or so.
GROUP_BLOCKS = 16
#: Words whose bucket a worker remembers; when full it starts anew.
CACHE_ENTRIES = 200_000

#: Bytes of a text by what they become: letters in lower case, digits and all bytes beyond ASCII stay, others part words.
FOLDED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)))

BLOCKS = "block long, doc_ids array<long>, n_words array<long>, n_features array<long>, starts array<long>, buckets array<int>, counts array<int>"


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text, A-Z in lower case."""
    return text.encode().translate(FOLDED).split() if text else []


class Buckets:
    """Buckets of the runs of words, remembered for those that repeat."""

    def __init__(self, n_buckets: int, max_n: int):
        self.n_buckets, self.max_n, self.known = n_buckets, max_n, {}

    def counts(self, words: list[bytes]) -> Counter:
        """bucket -> how often."""
        runs = Counter(words)
        for n in range(2, self.max_n + 1):
            runs.update(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        known, out = self.known, Counter()
        for run, n in runs.items():
            bucket = known.get(run)
            if bucket is None:
                bucket = known[run] = zlib.crc32(run) % self.n_buckets
            out[bucket] += n
        return out


def matrix(docs: DataFrame, n_buckets: int = 10_000, max_n: int = 1, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """The count matrix of docs as a table of blocks; without an id column ids are null."""
    small_batches(docs.sparkSession)
    ids = named(docs, id_col).cast("long") if id_col else F.lit(None).cast("long")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, made, hashed = TaskContext.get().partitionId(), 0, Buckets(n_buckets, max_n)
        schema = pa.schema([("block", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("doc_ids", "n_words", "n_features", "starts")), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

        def block(held):
            ids, n_words, rows = zip(*held)
            ends = np.cumsum([0, *map(len, rows)])
            entries = [np.fromiter(chain.from_iterable(part(r) for r in rows), np.int32, int(ends[-1])) for part in (Counter.keys, Counter.values)]
            columns = [ids, n_words, [r.total() for r in rows], ends, *entries]
            lists = [pa.array([c], t.type) for c, t in zip(columns, list(schema)[1:])]
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | made], pa.int64()), *lists], schema=schema)

        held, entries = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                held.append((doc_id, len(words), hashed.counts(words)))
                entries += len(held[-1][2])
                if len(held) >= BLOCK_DOCS or entries >= BLOCK_ENTRIES:
                    yield block(held)
                    held, entries, made = [], 0, made + 1
        if held:
            yield block(held)

    return docs.select(ids.alias("_id"), named(docs, text_col).cast("string").alias("_text")).mapInArrow(run, BLOCKS)


def column_sums(blocks: DataFrame, n_buckets: int) -> np.ndarray:
    """Sum of every column of the matrix; each task sends a row for each bucket at most."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for buckets, counts in zip(batch.column(0), batch.column(1)):
                np.add.at(total, buckets.values.to_numpy(zero_copy_only=False), counts.values.to_numpy(zero_copy_only=False).astype(np.int64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    sums = np.zeros(n_buckets, np.int64)
    for bucket, n in blocks.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # n_buckets rows at most
        sums[bucket] = n
    return sums


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the smoothed ratio of both distributions, floored."""
    n, big_s, big_t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (big_s + n) / ((s + 1) * (big_t + n)))) for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of a Gumbel variate from a hash of seed and id, floored."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(blocks: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of the matrix, and its place (block, k)."""
    spark = blocks.sparkSession
    sent = spark.sparkContext.broadcast(gain)  # n_buckets numbers
    names = ["block", "k", "doc_id", "n_words", "n_features", "weight", "score"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                block, ids, n_words, n_features, starts, buckets, counts = (batch.column(c)[row] for c in range(7))
                values = lambda x: x.values.to_numpy(zero_copy_only=False)
                product = np.concatenate([[0], np.cumsum(sent.value[values(buckets)] * values(counts))])
                starts = values(starts)
                weight = product[starts[1:]] - product[starts[:-1]]
                doc_ids = ids.values
                score = weight + np.array([noise(i, seed) for i in doc_ids.to_pylist()], np.int64)
                n = len(weight)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block.as_py())), pa.array(np.arange(n)), doc_ids, n_words.values, n_features.values, pa.array(weight), pa.array(score)], names)

    return blocks.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def ranked(rows: DataFrame, take: int) -> DataFrame:
    """rows with rank, from 1, of the take highest scores, ties to smaller doc_id; null for the others.

    One sort by ranges; the ranges' sizes, a number for each partition, give what stands before each.
    """
    spark = rows.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("block"), F.asc("k")]
    at = F.monotonically_increasing_id()  # the partition from bit 33, the place in it below
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at), "ranks")
    part = F.shiftright("at", 33).alias("part")
    sizes = sorted(placed.groupBy(part).count().collect())  # a row for each partition
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "part long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.when(rank <= take, rank)).drop("part", "before", "at")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, n_buckets: int = 10_000, max_n: int = 1, seed: int = 2024) -> DataFrame:
    """Every row of docs (doc_id, text): doc_id, n_features, weight, score, rank (null if not drawn).

    Drawn are percent of the documents with least_words words or more.  target needs a column text.
    """
    blocks = written(matrix(docs, n_buckets, max_n), "csr", GROUP_BLOCKS)
    wanted = matrix(target, n_buckets, max_n, None)
    gain = gains(column_sums(blocks, n_buckets), column_sums(wanted, n_buckets))
    rows = written(weighed(blocks, gain, seed), "weights")
    may = F.col("n_words") >= least_words
    take = percent * rows.filter(may).count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = ranked(rows.filter(may), take).select(*columns, "rank")
    return drawn.unionByName(rows.filter(~may).select(*columns, F.lit(None).cast("long").alias("rank")))
