"""Language of words by a linear-chain conditional random field, and of documents by their words.

A word is a run of letters with their combining marks, lower-cased; a run of more than LONGEST letters goes on in words
of at most LONGEST, and in scripts that are written without spaces every letter is a word of its own, so every letter
of a text counts.  A word's features are its affixes of one to four letters, its two- and three-letter n-grams with its
ends marked, itself, and for each language whether a lexicon of that language's characteristic words, learned as well,
holds it.  A chain's score adds feature weights and learned transitions;
forward-backward gives each word's probability of each language in its whole text, so words of code-switched text
get labels of their own.  A document's language has the largest mean probability over its words; that mean is its
score.

Every label that stands in the table is a class.  Fitting takes a bounded sample: of each language the DOCS documents
of smallest md5 of their id, and of each of these WINDOWS runs of RUN words, spread over the whole text.  Some runs of
different languages are joined to chains, so that transitions are learned from switches.  Everything else covers all
rows and whole texts: a long chain is cut into blocks whose transfer matrices are multiplied, and a longer one into
segments that hand each other what they know, which is exact, too, and bounds what is held at once.  With many
languages features are hashed to fewer slots, so that a model holds MODEL_BYTES at most; over MOST_LANGS labels are no
languages and an error.

A text that is null or has no letter is ``und`` with score 0.  If no row is labelled, all are ``und``.  Ties go to the
language that comes first in code-point order.  Repeated rows get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import named, small_batches, written

DOCS, WINDOWS, RUN, MOST_LANGS = 300, 4, 24, 2048
#: Slots of hashed weights, fewer with many languages; bytes of all of these.
SLOTS, MODEL_BYTES = 1 << 16, 1 << 25
#: Scores kept in a Python worker, in numbers; words of a block; numbers of a word and language labelled at a time, and those of a segment of a longer text.
CACHE_SCORES, BLOCK, BATCH_SCORES, SEGMENT_SCORES = 600_000, 32, 400_000, 400_000
LEXICON, LEXICON_SHARE = 200, 0.8
#: Letters of a word; a longer run is several words.
LONGEST = 40
#: Scripts written without spaces between words: Thai to Tibetan, Myanmar, Khmer, kana, Han.  Fixed values.
UNSPACED = "\u0e01-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aad\u3005-\u3007\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua9e0-\ua9ff\uaa60-\uaa7f\uf900-\ufaff\U0001b000-\U0001b16f\U00020000-\U000323af"
UNKNOWN = "und"


#: Words of texts without characters from U+0300 on, of which the last six look like letters to re; what tells of such.
PLAIN, FAR = re.compile(rf"[^\W\d_²³¹¼½¾]{{1,{LONGEST}}}"), re.compile("[\u0300-\U0010ffff]")
#: Runs of letters and marks of any text; letters of scripts without spaces, each with its marks.
RUNS, LONE = regex.compile(r"\p{L}[\p{L}\p{M}]*+"), regex.compile(rf"[{UNSPACED}]\p{{M}}*+|(?:[^{UNSPACED}]\p{{M}}*+){{1,{LONGEST}}}+")


def words_of(text: str | None) -> list[str]:
    """The words of a whole text, lower-cased."""
    low = (text or "").lower()
    if not FAR.search(low):
        return PLAIN.findall(low)
    return [w for run in RUNS.findall(low) for w in ((run,) if run.isascii() and len(run) <= LONGEST else LONE.findall(run))]


def slots_for(n_langs: int) -> int:
    """SLOTS, halved until the weights of n_langs languages fit in MODEL_BYTES."""
    slots = SLOTS
    while slots * n_langs * 4 > MODEL_BYTES and slots > 256:
        slots //= 2
    return slots


def features(words: list[str], n_slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all features of words, of every letter, and the number of the word that each belongs to.

    A feature's slot is a hash of its characters, its kind and its length, taken for all words at once.
    """
    marked = [f"<{w}>" for w in words]
    c = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    end = np.cumsum(size)
    start = end - size
    word = np.repeat(np.arange(len(marked)), size)
    place = np.arange(len(c)) - start[word]
    slots, owners = [_slot(np.add.reduceat(c * _powers(int(size.max()))[place], start), 1)], [np.arange(len(marked))]
    for n in (2, 3):
        at = np.flatnonzero(place + n <= size[word])
        slots.append(_slot(sum(c[at + k] * _powers(n)[k] for k in range(n)), n))
        owners.append(word[at])
    for n in (2, 3, 4, 5):
        has = np.flatnonzero(size >= n)
        for salt, head in ((8, start[has]), (16, end[has] - n)):
            slots.append(_slot(sum(c[head + k] * _powers(n)[k] for k in range(n)), salt + n))
            owners.append(has)
    return np.concatenate(slots) & (n_slots - 1), np.concatenate(owners)


def _powers(n: int) -> np.ndarray:
    """The first n powers of an odd number, modulo 2^64."""
    return np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))


def _slot(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(48)).astype(np.int64) & (SLOTS - 1)


def summed(weights: np.ndarray, slots: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """The weights at the slots, summed by owner."""
    return np.stack([np.bincount(owners, weights[slots, k], n) for k in range(weights.shape[1])], 1)


@dataclass
class Crf:
    """weights: slots x languages; lexicon: word -> languages; lexicon_weights and transitions: language x language."""

    langs: list[str]
    weights: np.ndarray
    lexicon: dict[str, list[int]]
    lexicon_weights: np.ndarray
    transitions: np.ndarray
    rows: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def scores(self, words: list[str]) -> np.ndarray:
        """Each word's summed weights, through a cache that starts anew when full."""
        rows = self.rows
        found = list(map(rows.get, words))
        if None in found:
            new = list({w for w, r in zip(words, found) if r is None})
            if self.table is None or len(rows) + len(new) > len(self.table):
                rows.clear()
                self.table = np.empty((max(CACHE_SCORES // len(self.langs), len(set(words))), len(self.langs)), np.float32)
                new = list(set(words))
            at = len(rows)
            self.table[at : at + len(new)] = self._fresh(new)
            rows.update(zip(new, range(at, at + len(new))))
            found = list(map(rows.__getitem__, words))
        return self.table[found].astype(np.float64)

    def _fresh(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.langs)), np.float32)
        for k in range(0, len(words), 1 << 13):
            part = words[k : k + (1 << 13)]
            out[k : k + (1 << 13)] = summed(self.weights, *features(part, len(self.weights)), len(part))
        for i, w in enumerate(words):
            for lang in self.lexicon.get(w, ()):
                out[i] += self.lexicon_weights[lang]
        return out

    def marginals(self, words: list[str], sizes: np.ndarray) -> np.ndarray:
        """Words of several chains, one after the other -> each word's probability of each language."""
        return forward_backward(self.scores(words), self.transitions, sizes)[0]


    def segments(self, words: list[str], size: int):
        """The marginals of one chain, segment after segment of size words; what a segment's neighbours know of its ends is added to the scores of its first and last word."""
        step = np.exp(self.transitions - self.transitions.max())
        parts = [words[k : k + size] for k in range(0, len(words), size)]
        before, after = [None] * len(parts), [None] * len(parts)

        def run(k: int, left: bool, right: bool):
            s = self.scores(parts[k])
            if left and before[k] is not None:
                s[0] += np.log(np.maximum(before[k], 1e-300))
            if right and after[k] is not None:
                s[-1] += np.log(np.maximum(after[k], 1e-300))
            return s, *forward_backward(s, self.transitions, np.array([len(parts[k])]))

        for k in range(len(parts) - 1):
            s, _, fore = run(k, True, False)
            own = fore[-1] * np.exp(s[-1] - s[-1].max())
            before[k + 1] = own / own.sum() @ step
        for k in range(len(parts) - 1, 0, -1):
            after[k - 1] = step @ run(k, False, True)[1][0]
        for k in range(len(parts)):
            yield run(k, True, True)[1]


def forward_backward(scores: np.ndarray, transitions: np.ndarray, sizes: np.ndarray, block: int = BLOCK):
    """Marginals of every word, and each word's forward vector before its own score; sizes: words of each chain, none 0.

    Chains are cut into blocks.  All blocks step together: first their transfer matrices, then, chain by chain from
    block to block, the vectors that enter them from both sides, last the vectors inside.
    """
    k = scores.shape[1]
    step = np.exp(transitions - transitions.max())
    own = np.exp(scores - scores.max(1, keepdims=True))
    per = -(-sizes // block)
    n, chain = int(per.sum()), np.repeat(np.arange(len(sizes)), per)
    order = np.arange(n) - np.repeat(np.cumsum(per) - per, per)  # a block's place in its chain
    first = np.repeat(np.cumsum(sizes) - sizes, per) + order * block
    length = np.minimum(block, np.repeat(np.cumsum(sizes), per) - first)
    head = order == 0
    grid = np.ones((block, n, k))
    for t in range(block):
        has = length > t
        grid[t, has] = own[first[has] + t]
    norm = lambda x: x / x.sum(-1, keepdims=True)
    through = np.tile(np.eye(k), (n, 1, 1))
    for t in range(block if n > len(sizes) else 0):
        has = length > t
        p = (through[has].reshape(-1, k) @ step).reshape(-1, k, k) * grid[t, has][:, None, :]
        if t == 0:  # nothing comes before a chain's first word
            p[head] = np.eye(k) * grid[0, head][:, None, :]
        through[has] = p / p.sum((1, 2), keepdims=True)
    enter, leave = np.ones((n, k)), np.ones((n, k))
    start = np.cumsum(per) - per
    for j in range(1, int(per.max())):
        at = start[per > j] + j
        enter[at] = norm(np.einsum("nk,nkl->nl", enter[at - 1], through[at - 1]) if j > 1 else through[at - 1].sum(1))
    for j in range(int(per.max()) - 2, -1, -1):
        at = start[per > j + 1] + j
        leave[at] = norm(np.einsum("nkl,nl->nk", through[at + 1], leave[at + 1]))
    out, before = np.empty_like(scores), np.empty_like(scores)
    a, fore = enter, np.empty((block, n, k))
    for t in range(block):
        prior = a @ step
        if t == 0:
            prior[head] = 1.0
        fore[t] = norm(prior)
        a = np.where((length > t)[:, None], norm(fore[t] * grid[t]), a)
    b = leave
    for t in range(block - 1, -1, -1):
        has = length > t
        out[first[has] + t] = norm((fore[t] * grid[t] * b)[has])
        before[first[has] + t] = fore[t][has]
        b = np.where(has[:, None], norm((grid[t] * b) @ step.T), b)
    return out, before


def fit(chains: list[tuple[list[str], list[int]]], langs: list[str], rounds: int = 6, rate: float = 0.4, decay: float = 1e-6, seed: int = 0) -> Crf:
    """Maximum likelihood by AdaGrad; chains: words and their languages' numbers.  A step touches only the slots that its chains' features have."""
    k, rng = len(langs), np.random.default_rng(seed)
    counts = [Counter() for _ in langs]
    for words, labels in chains:
        for w, y in zip(words, labels):
            counts[y][w] += 1
    all_counts = sum(counts, Counter())
    lexicon: dict[str, list[int]] = {}
    for y, c in enumerate(counts):
        held = 0
        for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0])):
            if n >= 3 and n >= LEXICON_SHARE * all_counts[w] and held < LEXICON:
                lexicon.setdefault(w, []).append(y)
                held += 1
    kinds = sorted(all_counts)
    number = {w: i for i, w in enumerate(kinds)}
    n_slots = slots_for(k)
    slots, owners = features(kinds, n_slots)
    by_owner = np.argsort(owners, kind="stable")
    flat, starts = slots[by_owner], np.cumsum([0, *np.bincount(owners, minlength=len(kinds))])
    lex = np.zeros((len(kinds), k))
    for w, ys in lexicon.items():
        lex[number[w], ys] = 1
    weights, lexicon_weights, transitions = np.zeros((n_slots, k)), np.zeros((k, k)), np.zeros((k, k))
    squares = [np.full_like(x, 1e-6) for x in (weights, lexicon_weights, transitions)]
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(len(chains)), max(1, len(chains) // 64)):
            ids = np.concatenate([[number[w] for w in chains[c][0]] for c in part])
            y = np.concatenate([chains[c][1] for c in part])
            sizes = np.array([len(chains[c][0]) for c in part])
            used, at = np.unique(ids, return_inverse=True)
            spans = [np.arange(starts[u], starts[u + 1]) for u in used]
            f = flat[np.concatenate(spans)]
            ends = np.cumsum([0, *map(len, spans)])
            owner = np.repeat(np.arange(len(used)), np.diff(ends))
            of_kind = summed(weights, f, owner, len(used)) + lex[used] @ lexicon_weights
            scores = of_kind[at]
            p, before = forward_backward(scores, transitions, sizes)
            gold = np.eye(k)[y]
            miss = np.zeros((len(used), k))
            np.add.at(miss, at, p - gold)
            touched, spot = np.unique(f, return_inverse=True)
            g = np.stack([np.bincount(spot, miss[owner, lang], len(touched)) for lang in range(k)], 1) + decay * weights[touched]
            inner = np.ones(len(ids), bool)
            inner[np.cumsum(sizes) - sizes] = False
            nxt = np.flatnonzero(inner)
            # of neighbours: what the model expects, and what is there
            came = _previous(scores, before, nxt)
            joint = came[:, :, None] * np.exp(transitions)[None] * (p[nxt] / np.maximum(np.einsum("nk,kl->nl", came, np.exp(transitions)), 1e-300))[:, None, :]
            gt = joint.sum(0) - gold[nxt - 1].T @ gold[nxt]
            squares[0][touched] += g * g
            weights[touched] -= rate * g / np.sqrt(squares[0][touched])
            for x, grad, sq in zip((lexicon_weights, transitions), (lex[used].T @ miss, gt), squares[1:]):
                sq += grad * grad
                x -= rate * grad / np.sqrt(sq)
    return Crf(langs, weights.astype(np.float32), lexicon, lexicon_weights.astype(np.float32), transitions)


def _previous(scores: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Forward vectors, own scores included, of the words before at."""
    x = before[at - 1] * np.exp(scores[at - 1] - scores[at - 1].max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def runs_of(words: list[str], windows: int = WINDOWS, run: int = RUN) -> list[list[str]]:
    """windows runs of words spread over the whole list."""
    if len(words) <= windows * run:
        return [words[i : i + run] for i in range(0, len(words), run)]
    return [words[i : i + run] for i in np.linspace(0, len(words) - run, windows).astype(int).tolist()]


def joined(runs: list[tuple[str, list[str]]], langs: list[str], seed: int = 0) -> list[tuple[list[str], list[int]]]:
    """Chains of one to three runs; those of several runs mix languages."""
    rng, number, out, k = np.random.default_rng(seed), {x: i for i, x in enumerate(langs)}, [], 0
    order = rng.permutation(len(runs)).tolist()
    while k < len(order):
        take = int(rng.choice((1, 1, 2, 3)))
        part = [runs[i] for i in order[k : k + take]]
        out.append(([w for _, ws in part for w in ws], [number[x] for x, ws in part for _ in ws]))
        k += take
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame) -> Crf | None:
    """From text and lang of the labelled documents that aren't held out."""
    spark = docs.sparkSession
    narrow = docs.select(named(docs, "doc_id").alias("doc_id"), named(docs, "lang").cast("string").alias("lang"), named(docs, "text").cast("string").alias("text"))
    known = narrow.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    digest = F.md5("text")
    # an id counts once in a language, whatever rows repeat it; of these the text of smallest digest stands for it
    ids = written(known.groupBy("lang", F.col("doc_id").cast("long").alias("id")).agg(F.min(digest).alias("digest")), "labelled")
    counts = {r.lang: r["count"] for r in ids.groupBy("lang").count().limit(MOST_LANGS + 1).collect()}
    if not counts:
        return None
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} labels are no languages")
    # the DOCS smallest of a language's marks, which are uniform, are among those under twice the mark that this many
    # have on average, 12 standard deviations sure; so a few rows of a language are ordered, whatever it holds
    bounds = spark.createDataFrame([(x, 2.0 * DOCS / n) for x, n in counts.items()], "lang string, bound double")
    marked = ids.withColumn("mark", F.md5(F.col("id").cast("string"))).join(F.broadcast(bounds), "lang")
    near = marked.filter(F.conv(F.substring("mark", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) < F.col("bound"))
    first = Window.partitionBy("lang").orderBy("mark", "id")
    picked = near.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= DOCS).select("id", "lang", "digest")
    chosen = spark.createDataFrame(picked.collect(), "id long, lang string, digest string")  # MOST_LANGS x DOCS rows at most
    texts = known.select(F.col("doc_id").cast("long").alias("id"), "lang", "text", digest.alias("digest"))

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            found = [(a, " ".join(r)) for a, t in zip(batch.column(0).to_pylist(), batch.column(1)) for r in runs_of(words_of(t.as_py())) if r]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], ["lang", "run"])

    # the ids are MOST_LANGS x DOCS at most, so is what is broadcast; rows that repeat one are alike, so tasks keep one
    sample = texts.join(F.broadcast(chosen), ["id", "lang", "digest"], "left_semi").groupBy("id", "lang").agg(F.min("text").alias("text"))
    runs = sorted((r.lang, r.run) for r in sample.select("lang", "text").mapInArrow(cut, "lang string, run string").collect())
    langs = sorted({x for x, _ in runs})
    if not langs:
        return None
    return fit(joined([(x, r.split(" ")) for x, r in runs], langs), langs)


_LOADED: dict[int, Crf] = {}


def _loaded(model) -> Crf:
    """One for each Python worker and model, with its cache."""
    if model.id not in _LOADED:
        _LOADED.clear()
        _LOADED[model.id] = model.value
    return _LOADED[model.id]


class Shipped:
    """A fitted model broadcast to the workers; it has MODEL_BYTES and a matrix of languages at most."""

    def __init__(self, spark, crf: Crf):
        import uuid

        self.id, self.inner = uuid.uuid4().hex, spark.sparkContext.broadcast(crf)

    @property
    def value(self) -> Crf:
        return self.inner.value


def label_words(crf: Crf, text: str | None) -> list[tuple[str, str, float]]:
    """Each word of a text with its language and that language's probability."""
    words = words_of(text)
    if not words:
        return []
    p = crf.marginals(words, np.array([len(words)]))
    best = p.argmax(1)
    return [(w, crf.langs[i], float(q)) for w, i, q in zip(words, best.tolist(), p.max(1).tolist())]


def predict(docs: DataFrame, crf: Crf | None, keep: list[str] | None = None) -> DataFrame:
    """keep (doc_id if none) and lang_pred, score, n_words, n_switches (between neighbouring words' languages)."""
    spark, keep = docs.sparkSession, keep or ["doc_id"]
    # a text that is kept is sent to Python once, inside its row
    text, held = named(docs, "text"), "text" in keep and docs.schema["text"].dataType.typeName() == "string"
    row = docs.select(F.struct(*[named(docs, c) for c in keep]).alias("row"), *([] if held else [text.cast("string").alias("t")]))
    if crf is None:
        return row.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_switches"))
    small_batches(spark)
    model = Shipped(spark, crf)

    def judged(texts):
        own = _loaded(model)
        out = []
        lists, total = [], 0

        def told(parts, n):
            """The label, score, words and switches of a text, from its marginals, part after part."""
            total, switches, last = 0.0, 0, None
            for q in parts:
                label = q.argmax(1)
                total = total + q.sum(0)
                switches += int((label[1:] != label[:-1]).sum()) + (last is not None and last != label[0])
                last = label[-1]
            best = int((total / n).argmax())
            return own.langs[best], float(min(1.0, total[best] / n)), n, int(switches)

        def flush():
            sizes = np.array([len(x) for x in lists])
            full = sizes > 0
            p = own.marginals([w for x in lists for w in x], sizes[full]) if full.any() else None
            at = 0
            for n in sizes.tolist():
                out.append(told([p[at : at + n]], n) if n else (UNKNOWN, 0.0, 0, 0))
                at += n
            lists.clear()

        for t in texts:
            words = words_of(t.as_py())
            if len(words) * len(own.langs) > SEGMENT_SCORES:
                flush()
                total = 0
                out.append(told(own.segments(words, max(1, SEGMENT_SCORES // len(own.langs))), len(words)))
                continue
            lists.append(words)
            total += len(words)
            if total * len(own.langs) >= BATCH_SCORES:
                flush()
                total = 0
        flush()
        return out

    fields, place = row.schema["row"].dataType, keep.index("text") if held else 0

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = judged(batch.column(0).field(place) if held else batch.column(1))
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in got], kind) for k, kind in enumerate(kinds))], ["row", "lang_pred", "score", "n_words", "n_switches"])

    kinds = (T.StructField("row", fields), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType()), T.StructField("n_switches", T.LongType()))
    return row.mapInArrow(run, T.StructType(list(kinds)))


#: A document goes if its language is unknown or its score is below this.
LEAST_SCORE = 0.5


def filtered(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs whose language the model tells, columns as they are."""
    return predict(docs, train(docs), docs.columns).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
