"""Flat token files with 64-bit document offsets.

Documents are dealt to shards of about SHARD_BYTES of text by ranges of doc_id, and of a hash of the text where ids are
equal or null, and sorted inside each, so shard after shard they stand in ascending order.  A shard is ``NNNNN.bin``, all ids one after the other as unsigned 16-bit (vocabularies up to
65,536) or 32-bit little-endian integers; ``NNNNN.idx``, 64-bit offsets of its documents and its end, counted
from its start; ``NNNNN.doc``, the documents' 64-bit ids; ``NNNNN.nil``, a byte for each that is 1 if the id is
null.  A shard's base, the ids before it in all shards, is the prefix sum of the shards' sizes.  Readers map the
files into memory and take any document by its offsets.

Null ids come first.  Rows of equal id stand side by side, ordered by XXH64 (seed 42, signed) of the text, then text.  A null or empty text has the end
id alone.  An empty table makes no shard and reads back as an empty table.
"""

from __future__ import annotations

import zlib
from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .forced_bpe import loaded, vocabulary
from .shared import SharedFiles, fresh_path, named, small_batches

#: Rows whose ids a writer holds before they go to the file, and rows that a reader gives out at a time.
WRITE_ROWS, READ_ROWS = 512, 4096
#: Text in a shard, and the least that is worth one.
SHARD_BYTES, LEAST_BYTES = 1 << 28, 1 << 20


@dataclass(frozen=True)
class TokenFiles:
    """Shards in order: (name, base, documents, ids), and the width of an id in the files."""

    root: str
    dtype: str
    shards: tuple[tuple[str, int, int, int], ...]


def shards_for(texts: DataFrame) -> int:
    """As many shards as SHARD_BYTES of text each make, or, of less text, four for each core as far as there is enough for them."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // SHARD_BYTES), min(4 * texts.sparkSession.sparkContext.defaultParallelism, -(-size // LEAST_BYTES)))


def write(docs: DataFrame, tokenizer: str, end_id: int = 0, shards: int | None = None, root: str | None = None) -> TokenFiles:
    """Encode every document of docs (doc_id, text) and write the shards."""
    spark = docs.sparkSession
    small_batches(spark)
    root = root or fresh_path(spark, "tokens")
    spec = vocabulary(spark, tokenizer)
    dtype = "<u2" if len(_pieces(spec.value)) <= 1 << 16 else "<u4"
    narrow = docs.select(named(docs, "doc_id").cast("long").alias("doc_id"), named(docs, "text").cast("string").alias("text"))
    n = shards or shards_for(narrow)
    order = (F.col("doc_id").asc_nulls_first(), F.col("h").asc_nulls_first())
    ordered = narrow.withColumn("h", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order, "text").drop("h")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        bpe, files, name = loaded(spec), SharedFiles(root), f"{TaskContext.get().partitionId():05d}"
        ids, nil, ends, total = array("q"), bytearray(), array("Q", [0]), 0
        end = np.asarray([end_id], dtype).tobytes()

        def chunks():
            nonlocal total
            held = []
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    held.append(np.frombuffer(bpe.encode(text.as_py()), "<u4").astype(dtype).tobytes() + end)
                    total += len(held[-1]) // len(end)
                    ids.append(doc_id or 0)
                    nil.append(doc_id is None)
                    ends.append(total)
                    if len(held) == WRITE_ROWS:
                        yield b"".join(held)
                        held.clear()
            yield b"".join(held)

        files.write(f"{name}.bin", chunks())
        files.write(f"{name}.idx", [np.asarray(ends, "<u8").tobytes()])
        files.write(f"{name}.doc", [np.asarray(ids, "<i8").tobytes()])
        files.write(f"{name}.nil", [bytes(nil)])
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(ids)], pa.int64()), pa.array([total], pa.int64())], ["name", "docs", "ids"])

    # one row of three values for each shard: as many as there are partitions
    return TokenFiles(root, dtype, in_order(ordered.mapInArrow(run, "name string, docs long, ids long").collect()))


def in_order(sizes) -> tuple[tuple[str, int, int, int], ...]:
    """(name, documents, ids) of shards as they come -> (name, base, documents, ids) by number; those without documents go."""
    kept = sorted((tuple(x) for x in sizes if x[1]), key=lambda x: int(x[0]))
    bases = np.cumsum([0, *(x[2] for x in kept)]).tolist()
    return tuple((name, base, docs, ids) for (name, docs, ids), base in zip(kept, bases))


def _pieces(spec: str) -> range:
    import json

    parsed = json.loads(spec)
    return range(max([*parsed["model"]["vocab"].values(), *(t["id"] for t in parsed["added_tokens"])]) + 1)


def document(files: TokenFiles, shard: int, k: int) -> np.ndarray:
    """The ids of document k of a shard, as a view of the mapped file."""
    src, name = SharedFiles(files.root), files.shards[shard][0]
    at = src.array(f"{name}.idx", "<u8")
    return src.array(f"{name}.bin", files.dtype)[int(at[k]) : int(at[k + 1])]


def read(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit integers)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files.shards:
        return spark.createDataFrame([], schema)

    def run(batches):
        import pyarrow as pa

        src = SharedFiles(files.root)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                name, base, n, _ = files.shards[shard]
                tokens, at = src.array(f"{name}.bin", files.dtype), src.array(f"{name}.idx", "<u8").astype(np.int64)
                nil = src.array(f"{name}.nil", "u1").astype(bool)
                ids = pa.array(np.array(src.array(f"{name}.doc", "<i8")), mask=nil)
                for k in range(0, n, READ_ROWS):
                    part = at[k : k + READ_ROWS + 1]
                    crc = [zlib.crc32(tokens[i:j].astype("<u4").tobytes()) for i, j in zip(part[:-1].tolist(), part[1:].tolist())]
                    yield pa.RecordBatch.from_arrays([ids.slice(k, len(crc)), pa.array(base + part[:-1]), pa.array(np.diff(part)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    k = len(files.shards)
    return spark.range(0, k, 1, k).mapInArrow(run, schema)
