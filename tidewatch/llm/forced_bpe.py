"""Byte-pair encoding by forced-boundary splitting, and decoding.

A byte pair that occurs inside no token of the vocabulary can never be merged over, so it is a certain
cut: what stands left and right of it is encoded on its own and the ids are concatenated.  The table of
such pairs comes from the vocabulary.  A text is cut at every certain pair where the pre-tokenizer's
pattern also sees the same pieces left and right of the cut, but never beside white space beyond ASCII; the
fragments are short and repeat, so a bounded cache holds their ids and the tokenizer library encodes the others.

Results, for any text, equal ``Tokenizer.encode(text, add_special_tokens=False).ids`` and
``Tokenizer.decode(ids, skip_special_tokens=False)``.  A null or empty text has no ids and decodes to "".
Repeated rows are encoded like any others; an empty table gives an empty table; the columns kept are
those asked for, whatever else the table holds.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import named, small_batches

#: White space beyond ASCII, and controls that some patterns count as such; the pre-tokenizer's \s may take these too.
WIDE_BLANKS = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u200c\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
WIDE_BYTES = re.compile(b"|".join(re.escape(c.encode()) for c in WIDE_BLANKS))
#: Characters whose class no version of Unicode has changed; fragments of these alone take the faster merge routine.
SETTLED = re.compile("[\x00-\x1b\x20-\x84\x86-\x9f\xa1-\u024f]*")
#: Fragments kept with their ids in a Python worker, and the longest that is kept.  When full it starts anew.
CACHE_ENTRIES, CACHED_BYTES = 200_000, 48

#: How byte-level tokenizers split a text before the merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, back to the byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def inner_pairs(tokens: list[bytes]) -> np.ndarray:
    """256 x 256: whether the byte pair occurs inside some token."""
    seen = np.zeros((256, 256), bool)
    for token in tokens:
        if len(token) > 1:
            raw = np.frombuffer(token, np.uint8)
            seen[raw[:-1], raw[1:]] = True
    return seen


def pattern_allows() -> np.ndarray:
    """256 x 256: whether a cut between the two bytes leaves the pre-tokenizer's pieces as they are.

    Valid but beside WIDE_BLANKS, where no cut is made.  The pattern looks only to the right, so a fragment that starts
    inside a run of letters, digits or signs ends where the run ends.  White space looks ahead, and an
    apostrophe may start a contraction: no cut after either, nor before an apostrophe that follows a sign,
    nor inside a contraction.  No cut before a continuation byte.
    """
    ok = np.ones((256, 256), bool)
    blank = [0x20, *range(0x09, 0x0E)]
    ok[blank, :] = False
    ok[ord("'"), :] = False
    signs = [b for b in range(0x80) if not chr(b).isalnum()] + list(range(0x80, 0x100))
    ok[signs, ord("'")] = False
    ok[:, 0x80:0xC0] = False
    for a, b in ("ve", "re", "ll"):
        ok[ord(a), ord(b)] = False
    return ok


class ForcedBpe:
    """Encoder and decoder of one byte-level BPE vocabulary, given as the text of its JSON file."""

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        parsed = json.loads(spec)
        alphabet = byte_alphabet()
        vocab = {i: bytes(map(alphabet.__getitem__, t)) for t, i in parsed["model"]["vocab"].items()}
        added = {t["id"]: t["content"] for t in parsed["added_tokens"]}
        self.cuts = (~inner_pairs(list(vocab.values())) & pattern_allows()).reshape(-1)
        self.pieces = [b""] * (max([*vocab, *added]) + 1)
        for i, piece in (vocab | {i: t.encode() for i, t in added.items()}).items():
            self.pieces[i] = piece
        self.added = re.compile("(" + "|".join(re.escape(t) for t in sorted(added.values(), key=len, reverse=True)) + ")") if added else None
        self.added_ids = {t: i for i, t in added.items()}
        self.cache: dict[bytes, bytes] = {}
        self.ranked = self._ranked(parsed["model"], vocab)

    @staticmethod
    def _ranked(model: dict, vocab: dict[int, bytes]):
        """The same merges in a routine for short pieces, if ids stand in the order of the merges; else None."""
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if [model["vocab"].get(m) for m in made] != list(range(256, 256 + len(made))):
            return None
        import tiktoken

        return tiktoken.Encoding("ranked", pat_str=PIECES, mergeable_ranks={t: i for i, t in vocab.items()}, special_tokens={})

    def fragments(self, raw: bytes) -> list[bytes]:
        if len(raw) < 2:
            return [raw]
        codes = np.frombuffer(raw, np.uint8)
        at = np.flatnonzero(self.cuts[(codes[:-1].astype(np.uint16) << 8) | codes[1:]]) + 1
        if not raw.isascii() or codes.min() < 0x20:
            beside = [x for m in WIDE_BYTES.finditer(raw) for x in m.span()]
            if beside:
                at = np.setdiff1d(at, beside, assume_unique=False)
        ends = [*at.tolist(), len(raw)]
        return [raw[i:j] for i, j in zip([0, *ends], ends)]

    def _segment(self, text: str) -> bytes:
        """Ids, as little-endian unsigned 32-bit integers, of a text without added tokens."""
        if not text:
            return b""
        cache, parts = self.cache, self.fragments(text.encode())
        found = list(map(cache.get, parts))
        if None in found:
            missing = list({p for p, f in zip(parts, found) if f is None})
            new = dict(zip(missing, self._encoded([m.decode() for m in missing])))
            found = [new[p] if f is None else f for p, f in zip(parts, found)]
            if len(cache) + len(new) > CACHE_ENTRIES:
                cache.clear()
            cache.update((p, ids) for p, ids in new.items() if len(p) <= CACHED_BYTES)
        return b"".join(found)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        if self.ranked is None:
            return self._library(texts)
        one = self.ranked.encode_ordinary
        return [array("I", one(t)).tobytes() if SETTLED.fullmatch(t) else self._library([t])[0] for t in texts]

    def _library(self, texts: list[str]) -> list[bytes]:
        encoded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in encoded]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.added is None or not self.added.search(text):
            return self._segment(text)
        bits = self.added.split(text)
        return b"".join(self.added_ids[b].to_bytes(4, "little") if k % 2 else self._segment(b) for k, b in enumerate(bits))

    def decode(self, ids: bytes) -> str:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_LOADED: dict[int, ForcedBpe] = {}


def loaded(spec) -> ForcedBpe:
    """The encoder of a broadcast vocabulary; one in each Python worker."""
    key = hash(spec.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ForcedBpe(spec.value)
    return _LOADED[key]


def vocabulary(spark, path: str):
    """The vocabulary file of a tokenizer, broadcast; its size is that of the file and doesn't follow the data."""
    with open(path, encoding="utf-8") as src:
        return spark.sparkContext.broadcast(src.read())


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of docs: its id, n_tokens, the digests of its ids and of the decoded text; with_ids adds the ids."""
    small_batches(docs.sparkSession)
    spec = vocabulary(docs.sparkSession, tokenizer)
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))

    def run(batches):
        import pyarrow as pa

        bpe = loaded(spec)
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                coded = [bpe.encode(text.as_py()) for text in batch.column(1)]
                columns = [batch.column(0), pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string())]
                columns.append(pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in coded], pa.string()))
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(np.cumsum([0, *(len(x) // 4 for x in coded)]).astype(np.int32), np.frombuffer(b"".join(coded), "<i4")))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return docs.select(named(docs, id_col).alias("_id"), named(docs, text_col).cast("string").alias("_text")).mapInArrow(run, T.StructType(fields))
