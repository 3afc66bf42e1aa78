"""Token alignment, importance resampling and packing, against plain versions of their contracts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from glob import glob
from itertools import groupby

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import best_fit_packing as packing
from tidewatch.llm import importance_resampling as resampling
from tidewatch.llm import token_alignment as alignment
from tidewatch.llm.forced_bpe import byte_alphabet
from tidewatch.llm.queries import tokenizer_path
from tidewatch.llm.shared import shared_dir

A, B, W = tokenizer_path(), tokenizer_path("piece_bpe_32k.model"), tokenizer_path("word_bpe_49k.json")
ODD = ["", None, "▁ no", "a  b\n\n c\t", "<|endoftext|> </s><s> <0x41>", "naïve Straße — 中文 😀 é", "\x00\x1c x", "word", "ﬁ ½ İ Σς", " lead", "trail "]


def docs_of(spark, sf="0.001", extra=()):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text")
    rows = [(1_000_000 + k, t) for k, t in enumerate(ODD)] + [(None, "null id"), (5, "twice"), (5, "twice"), *extra]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.unionByName(more).selectExpr("doc_id", "text", "'x' AS block", "1 AS number", "2 AS pair", "3 AS score", "4 AS length")


# alignment


def plain_alignment(rows):
    """By offsets at which both end, a dictionary of counts, and the libraries themselves."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    letters = byte_alphabet()
    told, counts = [], Counter()
    for doc_id, text in rows:
        a, b = ([], []) if not text else (a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text))
        a_bytes = [bytes(letters[c] for c in a_lib.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        want = (" " + (text or "")).encode()
        if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            a, b, a_bytes, b_bytes = [], [], [], []
        spans = lambda parts: [(sum(map(len, parts[:k])), sum(map(len, parts[: k + 1]))) for k in range(len(parts))]
        sa, sb = spans(a_bytes), spans(b_bytes)
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        text_of = lambda ids, s, lo, hi: ",".join(str(i) for i, (x, y) in zip(ids, s) if lo <= x and y <= hi)
        groups = ";".join(f"{text_of(a, sa, lo, hi)}|{text_of(b, sb, lo, hi)}" for lo, hi in zip([0, *cuts], cuts))
        links, k = [], 0
        for i, (x, y) in zip(a, sa):
            while k and sb[k - 1][1] > x:
                k -= 1
            while k < len(sb) and sb[k][0] < y:
                if sb[k][1] > x:
                    links.append((i, b[k]))
                k += 1
        counts.update(links)
        told.append((doc_id, len(a), len(b), len(cuts), links, groups))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted((-1 if i is None else i, na, nb, g, len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(s.encode()).hexdigest() if na else "") for i, na, nb, g, x, s in told)


def got_alignment(df):
    rows = df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in rows)


def test_alignment_equals_a_plain_version(spark):
    docs = docs_of(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_alignment(rows)
    assert got_alignment(alignment.align(docs.repartition(3), A, B)) == want
    assert sum(w[1] == 0 for w in want) >= 3 and sum(w[3] < min(w[1], w[2]) for w in want) > 50


def test_alignment_in_many_blocks(spark, monkeypatch):
    """Blocks of few links: a pair's count comes from all of them."""
    docs = spark.createDataFrame([(k, "the same words again and again " * (1 + k % 3)) for k in range(40)], "doc_id long, text string").repartition(4)
    want = got_alignment(alignment.align(docs, A, B))
    source = alignment._blocks

    def small(d, files):
        monkeypatch.setattr(alignment, "BLOCK_LINKS", 20)
        monkeypatch.setattr(alignment, "ALIGNED_BYTES", 50)
        return source(d, files)

    monkeypatch.setattr(alignment, "_blocks", small)
    assert got_alignment(alignment.align(docs, A, B)) == want == plain_alignment([(r.doc_id, r.text) for r in docs.collect()])


def test_alignment_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(none, A, B).collect() == []
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert got_alignment(alignment.align(only, A, B)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 30), st.lists(st.tuples(st.integers(0, 29), st.integers(0, 29)), max_size=60))
def test_union_find(n, edges):
    edges = [(a % n, b % n) for a, b in edges]
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    u, v = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    assert alignment.roots(n, u, v).tolist() == label


def test_groups_of_a_text():
    got = alignment.groups("Donaudampfschifffahrt naïve", A, B)
    a, b = ([i for g in got for i in g[k]] for k in (0, 1))
    with open(A, encoding="utf-8") as x, open(B, "rb") as y:
        both = alignment.Aligner(x.read(), y.read())
    for ga, gb in got:
        assert b"".join(both.a.pieces[i] for i in ga) == b"".join(both.b.bytes[i] for i in gb)
    assert (a, b) == tuple(x.tolist() for x in both.encode("Donaudampfschifffahrt naïve"))


# resampling


def plain_sample(docs, target, percent=10, least=20, n_buckets=10_000, max_n=1, seed=2024):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % n_buckets for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]

    rows = [(i, *features(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for *_, f in rows:
        s.update(f)
    for x in target:
        t.update(features(x)[1])
    big_s, big_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[k] + 1.0) * (big_s + n_buckets) / ((s[k] + 1.0) * (big_t + n_buckets)))) for k in range(n_buckets)]
    out = []
    for i, n, f in rows:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[k] for k in f)
        out.append((i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-sc, math.inf if i is None else i) for i, n, _, _, sc in out if n >= least)
    ranks = defaultdict(list)
    for k, key in enumerate(able[: percent * len(able) // 100]):
        ranks[key].append(k + 1)
    told = []
    for i, n, m, w, sc in out:
        mine = ranks.get((-sc, math.inf if i is None else i), []) if n >= least else []
        told.append((-1 if i is None else i, m, w, sc, mine.pop() if mine else -1))
    return sorted(told)


def got_sample(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_features, r.weight, r.score, -1 if r["rank"] is None else r["rank"]) for r in df.collect())


@pytest.mark.parametrize("how", [{}, {"max_n": 2, "percent": 35, "n_buckets": 97, "seed": 7, "least_words": 5}])
def test_sample_equals_a_plain_version(spark, how):
    copies = [(2_000_000 + k, "Copies of one long enough text stand here; " * 4) for k in range(30)] + [(3_000_000, "one id with equal texts " * 6)] * 20
    docs = docs_of(spark, extra=copies).repartition(5)
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = plain_sample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], **{"least" if k == "least_words" else k: v for k, v in how.items()})
    assert got_sample(resampling.resample(docs, target, **how)) == want
    assert sum(w[4] > 0 for w in want) > 10


def stored_files(spark):
    root = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}".removeprefix("file:")
    return set(glob(f"{root}/csr-*/*.parquet"))


def test_matrix_is_rows_of_counts(spark):
    blocks = resampling.matrix(spark.createDataFrame([(1, "a b a"), (2, None), (3, "ü A1")], "doc_id long, text string").coalesce(1), 50).collect()
    (b,) = blocks
    rows = [dict(zip(b.buckets[i:j], b.counts[i:j])) for i, j in zip(b.starts, b.starts[1:])]
    at = lambda w: zlib.crc32(w.encode()) % 50
    assert b.doc_ids == [1, 2, 3] and rows == [{at("a"): 2, at("b"): 1}, {}, dict(Counter([at("ü"), at("a1")]))]
    assert b.n_features == [3, 0, 2] == b.n_words


def test_stored_matrix_is_read_a_few_blocks_at_once(spark):
    """Many blocks of one task: the reader's memory must not grow with them."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'some word' AS text").coalesce(1)
    before = stored_files(spark)
    got = resampling.resample(docs, docs.limit(5), least_words=1).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 2001)) and {(r.n_features, r.weight) for r in got} == {(2, got[0].weight)}
    (stored,) = map(pq.read_metadata, stored_files(spark) - before)
    groups = [stored.row_group(k).num_rows for k in range(stored.num_row_groups)]
    assert sum(groups) == 20 and max(groups) <= 16


def test_sample_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "word " * 30), (2, None)], "doc_id long, text string")
    assert resampling.resample(none, some).collect() == []
    got = resampling.resample(some, none, percent=50).collect()
    assert sorted((r.doc_id, r.n_features, r["rank"]) for r in got) == [(1, 30, None), (2, 0, None)]
    assert [r["rank"] for r in resampling.resample(some, none, percent=100).collect() if r.doc_id == 1] == [1]


# packing


def plain_bins(lengths, bins):
    """One piece after the other, by falling length; ties by state don't matter for what bins hold."""
    cap = np.array(bins.capacities(), float)
    scale = np.array(bins.weights) / cap**2
    held, left = [], []
    for n in sorted(lengths, reverse=True):
        item = np.array([n, 1, n * n], float)
        best = None
        for k, r in enumerate(left):
            if (r >= item).all():
                score = (((r - item) ** 2) * scale).sum() if bins.rule == "norm" else -(r * item * scale).sum()
                if best is None or score < best[0]:
                    best = score, k
        if best is None:
            held.append([])
            left.append(cap.copy())
            best = 0, len(held) - 1
        held[best[1]].append(n)
        left[best[1]] -= item
    return sorted(held)


def filled(table):
    out = defaultdict(list)
    for length, _, n, at, each, offset in table.tolist():
        for k in range(n):
            out[at + k // each].append((offset + k % each * length, length))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60), st.sampled_from([packing.Bins(32), packing.Bins(32, 3), packing.Bins(32, 4, 256, weights=(1, 1, 1)), packing.Bins(32, rule="dot"), packing.Bins(32, 3, 500, "dot", (1, 0.5, 2))]))
def test_runs_of_bins_hold_what_one_by_one_gives(lengths, bins):
    lengths = [min(n, bins.longest()) for n in lengths]
    table, opened = packing.placements(Counter(lengths), bins)
    got = filled(table)
    assert sorted(got) == list(range(opened))
    for parts in got.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        tokens, documents, cost = bins.capacities()
        assert sum(n for _, n in parts) <= tokens and len(parts) <= documents and sum(n * n for _, n in parts) <= cost
    assert sorted(sorted((n for _, n in p), reverse=True) for p in got.values()) == plain_bins(lengths, bins)


def test_numbers_of_a_length_are_placed_once():
    rng = np.random.default_rng(1)
    counts = Counter(rng.integers(1, 2049, 300_000).tolist())
    table, opened = packing.placements(counts, packing.Bins())
    for length, rows in groupby(table[np.lexsort((table[:, 1], table[:, 0]))].tolist(), key=lambda r: r[0]):
        at = 0
        for r in rows:
            assert r[1] == at
            at += r[2]
        assert at == counts[length]
    tokens = sum(n * k for n, k in counts.items())
    assert -(-tokens // 2048) <= opened <= 1.002 * tokens / 2048
    huge, opened = packing.placements({n: k * 10**6 for n, k in counts.items()}, packing.Bins())  # 3 x 10^11 pieces
    assert len(huge) < 50_000 and opened <= 1.002 * tokens * 10**6 / 2048


def test_bins_that_are_none():
    for wrong in ({"rule": "first"}, {"documents": 0}, {"tokens": 0}):
        with pytest.raises(ValueError):
            packing.Bins(**wrong)
    with pytest.raises(ValueError):
        packing.placements({40: 1}, packing.Bins(32))
    assert packing.placements({}, packing.Bins())[1] == 0


def test_words_are_encoded_as_the_library_does():
    from tokenizers import Tokenizer

    library, coder = Tokenizer.from_file(W), packing.WordEncoder(open(W, encoding="utf-8").read())
    assert coder.ranked is not None
    rng = random.Random(5)
    signs = "abcdeEßéÉİŒœ'sStTrevmld  \n\t.,!?-0123²½–’“…€ \xa0\xad ́ẞΣς中<|>ȺȾƁ_©×\x1c\x85​"
    texts = [t for t in ODD if t] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) + "<|endoftext|> A" * (k % 40 == 0) for k in range(8000)]
    for text in texts:
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert coder.encode(None) == coder.encode("") == b""
    assert not packing.drops_blanks(open(A, encoding="utf-8").read())


def check_packing(rows, want_ids, longest, tokens):
    """Every piece once, of longest tokens at most; gapless sequences of at most tokens."""
    from_rows, at = defaultdict(list), defaultdict(list)
    for r in rows:
        from_rows[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        at[r.sequence_id].append((r.offset, r.length))
    for i, ids in want_ids.items():
        cut = [(k, s, len(ids[s : s + longest])) for k, s in enumerate(range(0, len(ids), longest))]
        assert sorted(from_rows[i]) == [(*c, zlib.crc32(np.asarray(ids[c[1] : c[1] + longest], "<u4").tobytes())) for c in cut], i
    for parts in at.values():
        parts.sort()
        end = 0
        for o, n in parts:
            assert o == end
            end += n
        assert end <= tokens
    return len(at)


def test_packing_of_documents(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(W)
    docs = docs_of(spark, extra=[(7_000_000, "long text, " * 3000)]).filter("doc_id <> 5 AND doc_id IS NOT NULL").repartition(4)
    ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    for bins in (packing.Bins(), packing.Bins(512, 3, 512 * 400, weights=(1, 0.3, 0.3))):
        packed = packing.pack(docs, W, bins, with_ids=True).cache()
        n = check_packing(packed.collect(), ids, bins.longest(), bins.tokens)
        assert n < 1.1 * sum(map(len, ids.values())) / bins.tokens or bins.documents
        for s in packing.sequences(packed).collect():
            assert len(s.ids) == s.ends[-1] <= bins.tokens
            for i, end, start in zip(s.doc_ids, s.ends, [0, *s.ends]):
                assert "".join(map(chr, s.ids[start:end])) in "".join(map(chr, ids[i]))


def test_packing_of_odd_rows(spark):
    rows = [(None, "a"), (None, None), (1, ""), (1, ""), (1, "b c")] + [(2, "same")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = packing.pack(docs, W).collect()
    assert len(got) == 105 and len({r.sequence_id for r in got}) == 1
    assert sorted((r.offset, r.length) for r in got)[-1] == (sum(r.length for r in got) - 1, 1)
    assert packing.pack(docs.filter("doc_id > 9"), W).collect() == []
    assert packing.sequences(packing.pack(docs.filter("doc_id > 9"), W, with_ids=True)).collect() == []
