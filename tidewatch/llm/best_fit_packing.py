"""Packing documents into sequences of bounded length by vector best fit.

Every document's ids and an end id are cut into pieces of a sequence's length at most; pieces go to bins with three
capacities: tokens, documents, and attention cost (the sum of squared lengths).  Pieces are taken by falling length,
and each goes to the open bin that holds it under every constraint and is best: the one of smallest weighted norm of
what remains after it ("norm"), or of largest weighted dot product of the piece and what remains ("dot").  A bin is
opened when none holds the piece.

A piece's demand follows from its length alone, so pieces of one length are alike, and so are bins that hold the same.
The decisions are therefore taken on runs of bins and counts of lengths: a histogram of as many numbers as a sequence
has tokens goes to the driver, however many documents there are, and the bins come out exactly as if pieces were
placed one by one.  What comes back are placements, each for a run of pieces of one length.  Pieces are numbered
among those of their length by counts of each task and prefix sums, and look their placement up by that number.

Null and empty texts are the end id alone.  Rows of equal id are rows of their own.  An empty table gives an empty
table.  Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .forced_bpe import byte_alphabet
from .shared import WORD, named, small_batches, written

#: Words whose ids a worker remembers, and the longest of these.  When full it starts anew.
CACHE_ENTRIES, CACHED_CHARS = 400_000, 32
#: Fixed values of the tokenizer's file: the mark of a word's end, and how lower-case text is split.
WORD_END, END_BYTE = "</w>", b"\xff"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters and numbers among SETTLED, characters whose class, case and composition no version of Unicode has changed.
LETTERS, NUMBERS = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af\u2c65\u2c66", r"0-9\xb2\xb3\xb9\xbc-\xbe"
SETTLED = re.compile(r"[\x09-\x0D\x20-\x7e\xa1-\xac\xae-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20ac]*")
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\x20\x09-\x0D{LETTERS}{NUMBERS}]+")
CHUNKS = re.compile(WORD)
#: Rows that a writer gives out at a time.
ROWS = 4096
#: Bits of a piece's number in the key of a lookup; lengths take those above.
NUMBER_BITS = 44


@dataclass(frozen=True)
class Bins:
    """Capacities of a bin and how one is chosen.  Without a limit on documents or cost, what tokens allow."""

    tokens: int = 2048
    documents: int | None = None
    cost: int | None = None
    rule: str = "norm"
    weights: tuple[float, float, float] = (1.0, 0.0625, 0.0625)

    def __post_init__(self):
        if self.rule not in ("norm", "dot") or min(self.capacities()) < 1 or self.capacities()[2] < self.tokens**2 and self.cost is None:
            raise ValueError(f"not a kind of bin: {self}")

    def capacities(self) -> tuple[int, int, int]:
        return self.tokens, self.tokens if self.documents is None else self.documents, self.tokens**2 if self.cost is None else self.cost

    def longest(self) -> int:
        """The longest piece that a bin holds."""
        tokens, _, cost = self.capacities()
        return min(tokens, int(np.sqrt(float(cost))))


def placements(counts: dict[int, int], bins: Bins) -> tuple[np.ndarray, int]:
    """Rows (length, first, n, bin, in a bin, offset) for pieces first .. first + n of a length, and the number of bins.

    Piece first + i goes to bin + i // (in a bin), at offset + i % (in a bin) * length.
    """
    capacity = np.array(bins.capacities(), np.int64)
    scale = np.array(bins.weights) / capacity.astype(float) ** 2
    start, size, left = [], [], np.empty((0, 3), np.int64)  # runs of bins that hold the same, and what remains in each bin
    out, opened, least = [], 0, min((n for n, k in counts.items() if k), default=0)
    for length in sorted((n for n, k in counts.items() if k), reverse=True):
        item = np.array([length, 1, length * length], np.int64)
        if (item > capacity).any():
            raise ValueError(f"no bin holds a piece of {length} tokens")
        done, todo = 0, counts[length]
        while todo:
            fits = np.flatnonzero((left >= item).all(axis=1))
            if len(fits):
                if bins.rule == "norm":
                    score = (((left[fits] - item).astype(float) ** 2) * scale).sum(axis=1)
                else:
                    score = -(left[fits].astype(float) * item * scale).sum(axis=1)
                k = int(fits[np.argmin(score)])
                # a bin that took one stays the best by norm while it holds more, and falls behind its like by dot product
                each = int((left[k] // item).min()) if bins.rule == "norm" else 1
            else:
                k, each = len(start), int((capacity // item).min())
                if bins.rule == "dot":
                    each = 1
                full = -(-todo // each) if bins.rule == "norm" else 1
                start.append(opened)
                size.append(full)
                left = np.vstack([left, capacity])
                opened += full
            first_bin, n_bins, remains = start[k], size[k], left[k].copy()
            whole = min(n_bins, todo // each)
            rest = todo - whole * each if whole < n_bins else 0
            used = int(capacity[0] - remains[0])
            taken = []
            for n_full, per in ((whole, each), (1 if rest else 0, rest)):
                if n_full and per:
                    at = first_bin + sum(t[0] for t in taken)
                    out.append((length, done, n_full * per, at, per, used))
                    taken.append((n_full, at, remains - per * item))
                    done, todo = done + n_full * per, todo - n_full * per
            gone = sum(t[0] for t in taken)
            if gone == n_bins:
                _, start[k], left[k] = taken[0]
                size[k] = taken[0][0]
                more = taken[1:]
            else:
                start[k], size[k], more = first_bin + gone, n_bins - gone, taken
            for n_full, at, rests in more:
                start.append(at)
                size.append(n_full)
                left = np.vstack([left, rests])
        open_runs = (left >= np.array([least, 1, least * least])).all(axis=1)
        if not open_runs.all():
            keep = np.flatnonzero(open_runs).tolist()
            start, size, left = [start[i] for i in keep], [size[i] for i in keep], left[open_runs]
    return np.array(out, np.int64).reshape(-1, 6), opened


class WordEncoder:
    """A tokenizer that drops white space, and splits what stands between into words that it encodes apart.

    Words of settled characters are split here and merged by a routine for single words with the same ranks; whatever
    stands between white space and holds another character, or a special token, goes to the tokenizer library.  Both
    are remembered.
    """

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        parsed = json.loads(spec)
        self.added = re.compile("|".join(re.escape(t["content"]) for t in parsed["added_tokens"]) or r"(?!)")
        self.ranked = self._ranked(parsed["model"])
        self.cache: dict[str, bytes] = {}

    @staticmethod
    def _ranked(model: dict):
        """The merges as ranks of bytes, if ids stand in their order; the end of a word is a byte that no text holds."""
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if model["end_of_word_suffix"] != WORD_END or [model["vocab"].get(m) for m in made] != list(range(512, 512 + len(made))):
            return None
        import tiktoken

        alphabet = byte_alphabet()
        raw = lambda t: bytes(map(alphabet.__getitem__, t.removesuffix(WORD_END))) + END_BYTE * t.endswith(WORD_END)
        return tiktoken.Encoding("ranked", pat_str=r"\S+", mergeable_ranks={raw(t): i for t, i in model["vocab"].items() if i < 512 + len(made)}, special_tokens={})

    def words(self, text: str) -> list[str]:
        """Words, and chunks for the library with a blank before them."""
        if self.ranked and SETTLED.fullmatch(text) and not self.added.search(text):
            return WORDS.findall(text.lower())
        out: list[str] = []
        for chunk in CHUNKS.findall(text):
            if self.ranked and SETTLED.fullmatch(chunk) and not self.added.search(chunk):
                out += WORDS.findall(chunk.lower())
            else:
                out.append(" " + chunk)
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        cache, parts = self.cache, self.words(text)
        found = list(map(cache.get, parts))
        if None in found:
            new = self._encoded(list({p for p, f in zip(parts, found) if f is None}))
            found = [new[p] if f is None else f for p, f in zip(parts, found)]
            if len(cache) + len(new) > CACHE_ENTRIES:
                cache.clear()
            cache.update((p, ids) for p, ids in new.items() if len(p) <= CACHED_CHARS)
        return b"".join(found)

    def _encoded(self, parts: list[str]) -> dict[str, bytes]:
        odd = [p for p in parts if p[0] == " "]
        new = {p: np.asarray(e.ids, "<u4").tobytes() for p, e in zip(odd, self.library.encode_batch_fast([p[1:] for p in odd], add_special_tokens=False))}
        if self.ranked:
            one = self.ranked._core_bpe.encode_single_piece
            new.update((p, array("I", one(p.encode() + END_BYTE)).tobytes()) for p in parts if p[0] != " ")
        return new


def drops_blanks(spec: str) -> bool:
    """Whether the file splits at white space, drops it, and does nothing else that could reach over it."""
    parsed = json.loads(spec)
    flat = lambda x, many: [] if x is None else x[many] if x["type"] == "Sequence" else [x]
    before, split = flat(parsed["normalizer"], "normalizers"), flat(parsed["pre_tokenizer"], "pretokenizers")
    plain = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in before)
    words = bool(split) and split[0]["type"] == "Split" and split[0]["behavior"] == "Removed" and split[0]["invert"] and split[0]["pattern"].get("Regex") == SPLIT
    apart = not any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in parsed["added_tokens"])
    return plain and words and apart and parsed["post_processor"] is None


_LOADED: dict[int, WordEncoder] = {}


def loaded(spec) -> WordEncoder:
    """The encoder of a broadcast vocabulary; one in each Python worker."""
    key = hash(spec.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordEncoder(spec.value)
    return _LOADED[key]


def pieces(docs: DataFrame, tokenizer: str, longest: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, and place: its task and its number there among those of its length."""
    small_batches(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as src:
        text = src.read()
    if not drops_blanks(text):
        raise ValueError(f"{tokenizer}: not a tokenizer that drops white space")
    spec = docs.sparkSession.sparkContext.broadcast(text)  # the vocabulary: its size doesn't follow the data
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, number long" + (", ids array<int>" if with_ids else "")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        coder, task, seen = loaded(spec), TaskContext.get().partitionId(), np.zeros(longest + 1, np.int64).tolist()
        end, width, held = np.asarray([end_id], "<u4").tobytes(), 4 * longest, []

        def batch_of(rows):
            ids, columns = [r[-1] for r in rows], list(zip(*(r[:-1] for r in rows)))
            arrays = [pa.array(c, pa.int32() if n == "piece" else pa.int64()) for c, n in zip(columns, names)]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32), np.frombuffer(b"".join(ids), "<i4")))
            return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = coder.encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    n = len(part) // 4
                    held.append((doc_id, k, at // 4, n, zlib.crc32(part), task, seen[n], part if with_ids else b""))
                    seen[n] += 1
                    if len(held) == ROWS:
                        yield batch_of(held)
                        held = []
        if held:
            yield batch_of(held)

    return docs.select(named(docs, "doc_id").cast("long").alias("_id"), named(docs, "text").cast("string").alias("_text")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, bins: Bins = Bins(), end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Every piece of docs (doc_id, text) and its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with_ids adds its ids."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, bins.longest(), end_id, with_ids), "pieces")
    counts = written(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # bins.longest() rows at most
    table, _ = placements(histogram, bins)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    sent = spark.sparkContext.broadcast(table)  # follows the number of lengths, not of documents
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = cut.join(bases, ["task", "length"]).withColumn("number", F.col("number") + F.col("base"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"

    def run(batches):
        import pyarrow as pa

        length, first, _, start, each, offset = sent.value.T
        keys = length << NUMBER_BITS | first
        for batch in batches:
            own, number = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            k = np.searchsorted(keys, own << NUMBER_BITS | number, "right") - 1
            nth = number - first[k]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(start[k] + nth // each[k]), pa.array(offset[k] + nth % each[k] * own)], [*names, "sequence_id", "offset"])

    return numbered.select(*names, "number").mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from pack(with_ids=True): sequence_id, ids, and doc_ids and ends of the pieces in order."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(inside.alias("parts"))
    ends = F.transform("parts", lambda p: p["offset"] + p["length"])
    return rows.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.col("parts.doc_id").alias("doc_ids"), ends.alias("ends"))
