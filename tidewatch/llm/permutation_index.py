"""Approximate nearest neighbours by a permutation index.

PIVOTS vectors are drawn from a bounded sample (SAMPLE rows of smallest md5 of their id).  A vector is represented by
the order of all pivots by nearness, kept as each pivot's place, a byte each, and is posted in the inverted files of its
POSTED nearest pivots; every vector is posted.  The index is dealt by hash to pieces of about PIECE vectors, each with
inverted files of its own, so that none is too large for one task; a query goes once to every piece.  There it visits
the files of PROBE_SHARE of the pivots, nearest first, and of more where these hold too few vectors for K neighbours.
Each vector met is ranked by footrule distance, the sum of the differences of places; the nearest by footrule are
joined to their vectors and ranked anew by the exact distance in double precision.

How many are ranked anew is measured, not fixed, as it has to grow with the number of vectors.  TRIALS of the queries
are answered by brute force; each true neighbour has a place in its query's footrule order, and the budget is the
smallest that holds the share TRIED of all these neighbours, CANDIDATES at least.  Where the files visited don't hold
that share, more are visited, in the end all.  A footrule bound for each query, which in a sample of SAMPLE vectors
lies four standard deviations beyond the budget's place, keeps tasks from giving out more than about the budget.

Every row has a number of its own inside, so rows of equal id stay apart: each is a candidate and takes a rank of its
own, except that a query meets no row of its own id.  Of equal vectors with equal ids only the first K rows, and of
equal vectors only those of the K + 1 smallest ids, can be among a query's K nearest; the others are left out of the
files, which changes no result and keeps copies from filling them.  Of queries with equal ids the one of smallest vector
is asked.

The share of files is set for vectors without structure, spread evenly over a sphere of 64 dimensions, where neighbours
are hardly nearer than others: recall there is over 0.9 (tests measure it).  Clustered vectors need a smaller share.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose length is not the
most frequent one of the table's, or whose id is null.  Queries need not be rows of the table.  Ties in distance go to
the smaller id.  An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import named, written

K, PIVOTS, POSTED, PROBE_SHARE, CANDIDATES, PIECE = 10, 256, 2, 0.45, 300, 16384
#: Rows that the pivots are drawn from; pivots are at most 256, a byte each, which bounds what is broadcast.
SAMPLE = 8192
#: Queries that the budget is measured on, and the share of their true neighbours that it has to hold.
TRIALS, TRIED = 64, 0.95
#: Candidates that a task holds before it gives them out.
HELD = 1_000_000


def sound(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (doubles) of the rows with an id and a vector of finite components, not all of them zero."""
    v = vectors.select(named(vectors, id_col).cast("long").alias("id"), named(vectors, vec_col).cast("array<double>").alias("vec"))
    limit = F.lit(float("inf"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & F.exists("vec", lambda x: x != 0)
    return v.filter(F.col("vec").isNotNull() & F.col("id").isNotNull()).filter(fine)


def needed(every: DataFrame, k: int) -> DataFrame:
    """rid, id, vec of the rows that can be among some query's k nearest, as far as rows of equal vectors tell.

    Vectors are compared by a hash first, which spares most comparisons of components.
    """
    marked = every.withColumn("h", F.xxhash64("vec"))
    copies = Window.partitionBy("h", "vec", "id").orderBy("rid")
    once = marked.withColumn("r", F.row_number().over(copies)).filter(F.col("r") <= k)
    ids = Window.partitionBy("h", "vec").orderBy("id")
    return once.withColumn("r", F.dense_rank().over(ids)).filter(F.col("r") <= k + 1).select("rid", "id", "vec")


def pick_pivots(vectors: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """Distinct vectors of the sample in a fixed random order."""
    sample = vectors.orderBy(F.md5(F.col("id").cast("string")), "id", "rid").limit(SAMPLE).select("vec").collect()
    have = np.unique(np.array([r.vec for r in sample]), axis=0)
    return have[np.random.default_rng(0).permutation(len(have))][: min(pivots, 256)]


def places_of(vecs: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pivots, nearest first, and each pivot's place in that order."""
    order = np.argsort((pivots**2).sum(1)[None, :] - 2 * vecs @ pivots.T, axis=1, kind="stable")
    place = np.empty(order.shape, np.uint8)
    np.put_along_axis(place, order, np.arange(order.shape[1], dtype=np.uint8)[None], 1)
    return order, place


def permutations(vectors: DataFrame, pivots, first: int) -> DataFrame:
    """rid, id, vec -> rid, id, place (a byte for each pivot), near (numbers of the first nearest pivots); pivots: broadcast."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                order, place = places_of(part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), pivots.value)
                near = pa.array(list(order[:, :first].astype(np.int32)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in place], pa.binary()), near], ["rid", "id", "place", "near"])

    return vectors.select("rid", "id", "vec").mapInArrow(run, "rid long, id long, place binary, near array<int>")


def footrule(query: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sum of the differences of places between a permutation and each row of others."""
    return (np.maximum(places, query) - np.minimum(places, query)).sum(1, dtype=np.int64)


class Nearest:
    """The nearest candidates of each query, rows (id, rid), over the pieces that a task has read."""

    def __init__(self, most: int):
        self.most, self.found, self.held = most, {}, 0

    def add(self, query: int, ids: np.ndarray, rids: np.ndarray, distances: np.ndarray) -> None:
        self.found.setdefault(query, []).append((distances, ids, rids))
        self.held += len(ids)

    def prune(self) -> int:
        """Leave each query the candidates that can be among its nearest; how many there are."""
        for q, parts in self.found.items():
            d, ids, rids = (np.concatenate([p[k] for p in parts]) for k in range(3))
            first = np.lexsort((rids, ids, d))[: self.most]
            self.found[q] = [(d[first], ids[first], rids[first])]
        self.held = sum(len(p[0][0]) for p in self.found.values())
        return self.held

    def taken(self):
        """All that is held, pruned, as a batch; nothing is held after."""
        import pyarrow as pa

        parts = [(np.full(len(p[0][0]), q), *p[0]) for q, p in self.found.items()]
        columns = [np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(4)]
        self.found, self.held = {}, 0
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "footrule", "id", "rid"])


def visited(near: np.ndarray, length: np.ndarray, share: float, k: int) -> int:
    """How many of the inverted files, in a query's order, it goes to; length: of each."""
    return max(int(np.ceil(share * len(length))), int(np.searchsorted(np.cumsum(length[near]), POSTED * (k + 1))) + 1)


def true_neighbours(index: DataFrame, trials: list, k: int) -> dict[int, list]:
    """Rows (id, vec) of the k nearest of each trial, a row with id and vec, by brute force."""
    own_ids, own = np.array([r.id for r in trials]), np.array([r.vec for r in trials])

    def nearest(batches):
        import pyarrow as pa

        best = Nearest(k)
        for batch in batches:
            rids, ids = (batch.column(j).to_numpy() for j in (0, 1))
            vecs = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            for t in range(len(own)) if len(ids) else ():
                other = np.flatnonzero(ids != own_ids[t])
                best.add(t, ids[other], rids[other], ((vecs[other] - own[t]) ** 2).sum(1))
            best.prune()
        found = [(t, float(d), int(i), int(r)) for t, p in best.found.items() for d, i, r in zip(*p[0])]
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], kind) for c, kind in enumerate(kinds)], ["t", "square", "id", "rid"])

    last = Window.partitionBy("t").orderBy("square", "id", "rid")
    met = index.select("rid", "id", "vec").mapInArrow(nearest, "t long, square double, id long, rid long")
    top = met.withColumn("r", F.row_number().over(last)).filter(F.col("r") <= k).select("t", "rid")
    out: dict[int, list] = {}
    for r in index.select("rid", "vec").join(F.broadcast(top), "rid").collect():  # TRIALS x k at most
        out.setdefault(r.t, []).append(r)
    return out


def budget(index: DataFrame, places: DataFrame, asked: DataFrame, pivots: np.ndarray, length: np.ndarray, k: int, least: int, share: float) -> tuple[int, float]:
    """Candidates to rank anew and share of the inverted files to visit that the trials need, least and share at least."""
    trials = asked.orderBy(F.md5(F.concat(F.lit("trial "), F.col("id").cast("string"))), "id").limit(TRIALS).select("id", "vec").collect()
    true = true_neighbours(index, trials, k) if trials else {}
    if not true:
        return least, share
    order, place = places_of(np.array([r.vec for r in trials]), pivots)
    shares = [share, (1 + share) / 2, 1.0]
    takes = [[visited(order[t], length, x, k) for t in range(len(trials))] for x in shares]
    bounds, inside = {}, {}  # of each trial's true neighbours: footrule distances, and how near the trial their files are
    for t, rows in true.items():
        near, own = places_of(np.array([r.vec for r in rows]), pivots)
        bounds[t], inside[t] = footrule(place[t], own), place[t][near[:, :POSTED]].min(1)

    def count(batches):
        import pyarrow as pa

        before = {t: np.zeros((len(shares), len(b)), np.int64) for t, b in bounds.items()}
        for batch in batches:
            places = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            near = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for t in bounds if batch.num_rows else ():
                first, far = place[t][near].min(1), footrule(place[t], places)
                for x in range(len(shares)):
                    before[t][x] += np.searchsorted(np.sort(far[first < takes[x][t]]), bounds[t], "right")
        found = [(t, x, j, int(n)) for t, b in before.items() for x in range(len(shares)) for j, n in enumerate(b[x])]
        yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(4)], ["t", "x", "j", "n"])

    rows = places.select("place", "near").mapInArrow(count, "t long, x long, j long, n long").groupBy("t", "x", "j").agg(F.sum("n").alias("n")).collect()
    for x, wide in enumerate(shares):
        ranks = sorted(r.n if inside[r.t][r.j] < takes[x][r.t] else np.inf for r in rows if r.x == x)
        need = ranks[int(np.ceil(TRIED * len(ranks))) - 1]
        if need < np.inf:
            break
    return max(least, int(need)), wide


class Files:
    """The inverted files of a piece: for each pivot the vectors that are posted under it."""

    def __init__(self, ids: np.ndarray, rids: np.ndarray, places: np.ndarray, near: np.ndarray):
        self.ids, self.rids, self.places = ids, rids, places
        pivot, row = near.reshape(-1), np.repeat(np.arange(len(ids)), near.shape[1])
        by_pivot = np.argsort(pivot, kind="stable")
        self.rows, self.ends = row[by_pivot], np.cumsum(np.bincount(pivot, minlength=places.shape[1]))

    def met(self, place: np.ndarray, take: int, bound: int, own_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors in the files of a query's take nearest pivots, not of its own id, with footrule distances up to bound."""
        seen = np.zeros(len(self.ids), bool)
        for p in np.argsort(place, kind="stable")[:take].tolist():
            seen[self.rows[self.ends[p - 1] if p else 0 : self.ends[p]]] = True
        at = np.flatnonzero(seen & (self.ids != own_id))
        far = footrule(place, self.places[at])
        close = far <= bound
        return at[close], far[close]


def search(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, candidates: int = CANDIDATES, probe_share: float = PROBE_SHARE, piece: int = PIECE) -> DataFrame:
    """query_id, rank (from 1), id, score: the k nearest found of each query by Euclidean distance; candidates and probe_share are what it starts from."""
    spark = vectors.sparkSession
    every = written(sound(vectors, id_col, vec_col).withColumn("rid", F.monotonically_increasing_id()), "vectors")  # read again, a row's number stays
    common = every.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not common:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    index = written(needed(every.filter(F.size("vec") == common[0].n), k), "index")
    asked = sound(queries, id_col, vec_col).filter(F.size("vec") == common[0].n).groupBy("id").agg(F.min("vec").alias("vec")).withColumn("rid", F.col("id"))
    asked = written(asked, "queries")
    chosen = pick_pivots(index, pivots)
    shipped, m = spark.sparkContext.broadcast(chosen), len(chosen)
    places = written(permutations(index, shipped, POSTED), "places")
    sizes = {r.pivot: r["count"] for r in places.select(F.explode("near").alias("pivot")).groupBy("pivot").count().collect()}  # one number for each pivot
    length = np.array([sizes.get(p, 0) for p in range(m)])
    candidates, probe_share = budget(index, places, asked, chosen, length, k, candidates, probe_share)

    sample = places.orderBy(F.md5(F.concat(F.lit("bound "), F.col("id").cast("string"))), "id", "rid").limit(SAMPLE).select("place", "near").collect()
    drawn = spark.sparkContext.broadcast((np.frombuffer(b"".join(bytes(r.place) for r in sample), np.uint8).reshape(len(sample), -1), np.array([r.near for r in sample])))
    total = places.count()
    due = candidates * len(sample) / max(1, total)
    due = int(np.ceil(due + 4 * np.sqrt(due) + 4))

    def route(batches):
        """near: how many files the query visits, and its footrule bound."""
        import pyarrow as pa

        for batch in batches:
            near = []
            for place in batch.column(2).to_pylist():
                own, (others, homes) = np.frombuffer(place, np.uint8), drawn.value
                take = visited(np.argsort(own, kind="stable"), length, probe_share, k)
                far = np.sort(footrule(own, others[own[homes].min(1) < take]))
                near.append([take, int(far[due]) if due < len(far) else m * m])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(near, pa.list_(pa.int32()))], ["id", "place", "near"])

    routed = permutations(asked, shipped, POSTED).mapInArrow(route, "id long, place binary, near array<int>")
    pieces = -(-total // piece)
    to_all = routed.select("id", F.lit(0).cast("long").alias("rid"), "place", "near", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"), F.lit(1).alias("kind"))
    dealt = places.select("id", "rid", "place", "near", F.pmod(F.xxhash64("rid"), F.lit(pieces)).cast("int").alias("piece"), F.lit(0).alias("kind"))
    keyed = dealt.unionByName(to_all).repartition("piece").sortWithinPartitions("piece", "kind", "id", "rid")  # a piece's vectors, then the queries

    def scan(batches):
        key, best, held, files = None, Nearest(candidates), [], None
        for batch in batches:
            ids, rids, piece_of, kind = (batch.column(j).to_numpy(zero_copy_only=False) for j in (0, 1, 4, 5))
            places = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, m)
            turn = np.flatnonzero((piece_of[1:] != piece_of[:-1]) | (kind[1:] != kind[:-1])) + 1
            for i, j in zip([0, *turn.tolist()], [*turn.tolist(), len(ids)]) if len(ids) else ():
                if piece_of[i] != key:
                    key, held, files = piece_of[i], [], None
                near = batch.column(3).slice(i, j - i).flatten().to_numpy(zero_copy_only=False).reshape(j - i, -1)
                if kind[i] == 0:
                    held.append((ids[i:j], rids[i:j], places[i:j], near))
                    continue
                if not held:
                    continue
                if files is None:
                    files = Files(*(np.concatenate([h[c] for h in held]) for c in range(4)))
                for q in range(i, j):
                    at, far = files.met(places[q], int(near[q - i, 0]), int(near[q - i, 1]), ids[q])
                    best.add(int(ids[q]), files.ids[at], files.rids[at], far)
                    if best.held > HELD and best.prune() > HELD // 2:
                        yield best.taken()
        best.prune()
        yield best.taken()

    met = keyed.mapInArrow(scan, "query_id long, footrule long, id long, rid long")
    best = Window.partitionBy("query_id").orderBy("footrule", "id", "rid")
    short = met.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= candidates).select("query_id", "rid")
    pairs = short.join(index.select("rid", "id", F.col("vec").alias("v")), "rid").join(asked.select(F.col("id").alias("query_id"), F.col("vec").alias("q")), "query_id")
    square = F.aggregate(F.zip_with("q", "v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.select("query_id", "id", "rid", F.sqrt(square).alias("score"))
    last = Window.partitionBy("query_id").orderBy("score", "id", "rid")
    return scored.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
