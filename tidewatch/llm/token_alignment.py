"""Alignment of the tokens of two tokenizers, and counts of the id pairs that share bytes.

Both tokenizers' tokens of a text tile the same bytes.  Tokens are the nodes of a bipartite graph whose edges join an A
token and a B token that share a byte; union-find gives its connected components, and these are exactly the smallest
groups of tokens that cover the same bytes.  The members of a component expand its links, the overlapping pairs.

Counts.  A task gives every id pair of a block of links a number, keeps each link as that number, and sends one row
for each pair of a block with its count, so a pair that every text holds is one row of a block.  Summed over all blocks,
pairs get their count, and whether it is the highest of their B id.  The answers go back by block and meet its
documents there, so a group of that join is a block, whose size is a constant.

A is a byte-level BPE and reads a space and the text; B is a SentencePiece BPE, which adds the space itself.  Special
tokens' strings in texts are plain text.  A null or empty text has no tokens, nor has one whose tokens' bytes differ from
the text's (a text with the sign U+2581).  Rows of equal id are rows of their own.  An empty table gives an empty table.
Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forced_bpe import ForcedBpe
from .shared import named, small_batches, written

#: A block ends with the document that brings it to so many links; texts of so many bytes are aligned at once.
BLOCK_LINKS, ALIGNED_BYTES = 1 << 22, 1 << 20
BLANK = "▁"

RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long"


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union-find over n nodes and the edges (u, v): every node's smallest node of its component.

    All edges hook at once, larger roots under smaller, and paths are halved until they are flat.
    """
    parent = np.arange(n)
    while True:
        ru, rv = parent[u], parent[v]
        apart = ru != rv
        if not apart.any():
            return parent
        u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
        np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (A token, B token) that share bytes, in the order of these; both tile the same bytes."""
    n = int(ends_a[-1]) + 1 if len(ends_a) else 0
    is_a, is_b = np.zeros(n, bool), np.zeros(n, bool)
    is_a[ends_a], is_b[ends_b] = True, True
    cut = np.flatnonzero(is_a | is_b)
    token = lambda ends: np.cumsum(ends[cut]) - ends[cut]
    return token(is_a), token(is_b)


class Pieces:
    """SentencePiece BPE, and the bytes of its tokens."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(BLANK, " ").encode()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return np.asarray(self.model.encode(text, num_threads=1), "<u4").tobytes()


class PlainBpe(ForcedBpe):
    """Forced-boundary BPE to which special tokens' strings are plain text."""

    def __init__(self, spec: str):
        super().__init__(spec)
        self.library.encode_special_tokens = True
        self.added = None


class Aligner:
    """Both tokenizers, and the alignment of many texts at once."""

    def __init__(self, spec: str, model: bytes):
        self.a, self.b = PlainBpe(spec), Pieces(model)
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.a.pieces, self.b.bytes))
        self.shift = max(len(self.size_a), len(self.size_b))
        self.strings = [b"%d%s" % (i, sign) for sign in (b",", b"|", b";") for i in range(self.shift)]

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and B; none where the joined bytes aren't the text's."""
        none = np.empty(0, "<u4")
        if not text or BLANK in text:
            return none, none
        raw = b" " + text.encode()
        ids = tuple(np.frombuffer(x, "<u4") for x in (self.a.encode(" " + text), self.b.encode(text)))
        same = all(b"".join(map(names.__getitem__, x.tolist())) == raw for names, x in zip((self.a.pieces, self.b.bytes), ids))
        return ids if same else (none, none)

    def align(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list, np.ndarray, np.ndarray]:
        """For each text n_a, n_b, n_groups, n_links and the digest of its groups; then all links' A ids and B ids in order.

        The texts' bytes stand one after the other; both tokenizers end a token where a text ends, so no component
        holds tokens of two.
        """
        a, b = (np.concatenate([t[k] for t in texts]).astype(np.int64) for k in (0, 1))
        n_a, n_b = (np.array([len(t[k]) for t in texts]) for k in (0, 1))
        link_a, link_b = overlaps(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        root = roots(len(a) + len(b), link_a, link_b + len(a))  # an A token, as these come first
        group = np.cumsum(root[: len(a)] == np.arange(len(a))) - 1
        of = group[root]  # every token's group, in the order of the text
        bounds_a, bounds_b = np.cumsum([0, *n_a]), np.cumsum([0, *n_b])
        first_link = np.searchsorted(link_a, bounds_a)
        n_groups = np.diff(np.concatenate([[0], np.cumsum(root[: len(a)] == np.arange(len(a)))])[bounds_a])
        # groups as text: A's ids, then B's, each but the last of its side with a comma
        side = of * 2 + np.concatenate([np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
        order = np.argsort(side, kind="stable")
        side = side[order]
        last = np.append(side[1:] != side[:-1], True) if len(side) else np.empty(0, bool)
        code = (np.concatenate([a, b])[order] + self.shift * np.where(last, 1 + side % 2, 0)).tolist()
        bounds, spell = bounds_a + bounds_b, self.strings.__getitem__
        digests = [hashlib.sha256(b"".join(map(spell, code[i:j]))[:-1]).hexdigest() if j > i else "" for i, j in pairwise(bounds.tolist())]
        return list(zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), np.diff(first_link).tolist(), digests)), a[link_a], b[link_b]


_LOADED: dict[tuple[int, int], Aligner] = {}


def loaded(files) -> Aligner:
    """The aligner of two broadcast files; one in each Python worker."""
    spec, model = files.value
    key = hash(spec), hash(model)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Aligner(spec, model)
    return _LOADED[key]


def _blocks(docs: DataFrame, files) -> DataFrame:
    """Rows of two kinds by block: documents with their links as numbers of pairs, and (without digest) a part of the pairs by number, with counts."""
    schema = f"block long, {RESULT}, groups_sha256 string, links binary, first int, pairs array<long>, counts array<long>"
    narrow = docs.select(named(docs, "doc_id").cast("long").alias("_id"), named(docs, "text").cast("string").alias("_text"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        both, task = loaded(files), TaskContext.get().partitionId()
        kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "first", "pairs", "counts"]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        def flushed(block, rows, keys):
            pairs, numbers, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            numbers = numbers.astype("<u2" if len(pairs) <= 1 << 16 else "<u4")
            at = np.cumsum([0, *(r[4] for r in rows)]).tolist()
            for k in range(0, len(rows), 1000):
                yield batch_of([(block, *r, numbers[i:j].tobytes(), None, None, None) for r, i, j in zip(rows[k : k + 1000], at[k:], at[k + 1 :])])
            for k in range(0, len(pairs), 1 << 16):
                yield batch_of([(block, None, None, None, None, None, None, None, k, pairs[k : k + (1 << 16)], counts[k : k + (1 << 16)])])

        def parts():
            held, size = [], 0
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    text = text.as_py()
                    held.append((doc_id, both.encode(text)))
                    size += len(text or "")
                    if size >= ALIGNED_BYTES:
                        yield held
                        held, size = [], 0
            if held:
                yield held

        rows, keys, links, made = [], [], 0, 0
        for part in parts():
            told, a, b = both.align([ids for _, ids in part])
            rows += [(doc_id, *t) for (doc_id, _), t in zip(part, told)]
            keys.append(a << 32 | b)
            links += len(a)
            if links >= BLOCK_LINKS:
                yield from flushed(task << 32 | made, rows, keys)
                rows, keys, links, made = [], [], 0, made + 1
        if rows:
            yield from flushed(task << 32 | made, rows, keys)

    return narrow.mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, number, pair, n) of every block's pairs, and (pair, count, best) of the whole corpus' pairs."""
    spread = blocks.filter("pairs IS NOT NULL").select("block", "first", F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "x"))
    sent = spread.select("block", (F.col("first") + F.col("at")).alias("number"), F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    counts = written(sent.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1)), "pairs")
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    return sent, counts.join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def _tallied(left, right):
    """The documents of one block with the answers to its pairs."""
    import pyarrow as pa

    # the numbers of a block's pairs are 0, 1, ..
    number = right.column("number").to_numpy()
    count, best = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    count[number], best[number] = right.column("count").to_numpy(), right.column("best").cast(pa.int64()).to_numpy()
    kind = "<u2" if len(number) <= 1 << 16 else "<u4"
    links = [np.frombuffer(x.as_py(), kind) for x in left.column("links")]
    sums = [(int(best[x].sum()), int(count[x].sum())) for x in links]
    out = left.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    for k, name in enumerate(("n_best", "count_sum")):
        out = out.append_column(name, pa.array([s[k] for s in sums], pa.int64()))
    return out.append_column("groups_sha256", left.column("groups_sha256"))


def align(docs: DataFrame, tokenizer_a: str, model_b: str) -> DataFrame:
    """Every row of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_a, encoding="utf-8") as a, open(model_b, "rb") as b:
        files = spark.sparkContext.broadcast((a.read(), b.read()))  # the vocabularies: their sizes don't follow the data
    blocks = written(_blocks(docs, files), "aligned")
    sent, counts = pair_counts(blocks)
    answers = sent.join(counts, "pair").select(F.col("block").alias("of"), "number", "count", "best")
    rows = blocks.filter("groups_sha256 IS NOT NULL").drop("first", "pairs", "counts")
    return rows.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_tallied, f"{RESULT}, n_best long, count_sum long, groups_sha256 string")


def groups(text: str | None, tokenizer_a: str, model_b: str) -> list[tuple[list[int], list[int]]]:
    """The groups of one text: A's ids and B's ids of each."""
    with open(tokenizer_a, encoding="utf-8") as a, open(model_b, "rb") as b:
        both = Aligner(a.read(), b.read())
    a, b = both.encode(text)
    link_a, link_b = overlaps(np.cumsum(both.size_a[a]), np.cumsum(both.size_b[b]))
    root = roots(len(a) + len(b), link_a, link_b + len(a))
    out: dict[int, tuple[list[int], list[int]]] = {}
    for k, (i, r) in enumerate(zip([*a.tolist(), *b.tolist()], root.tolist())):
        out.setdefault(r, ([], []))[k >= len(a)].append(i)
    return list(out.values())
