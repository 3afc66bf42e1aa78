"""Neighbours, quotations, URL lists, near-duplicates, mixture, pipeline."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import crf_language, curriculum_mix, permutation_index, quality_rules, quotation_linking, shared, simhash_slices, temporal_url_filter
from tidewatch.llm.components import components
from tidewatch.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

# neighbours


def exact(vectors, q, k=10):
    own = vectors[q]
    d = sorted((math.sqrt(((v - own) ** 2).sum()), i) for i, v in vectors.items() if i != q)
    return d[:k]


@pytest.mark.parametrize("n,clustered", [(1500, False), (1500, True)])
def test_recall(spark, n, clustered):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(n, 32)) + (10 * rng.normal(size=(6, 32))[rng.integers(0, 6, n)] if clustered else 0)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in permutation_index.search(df, df.filter("vec_id % 50 = 0"), piece=200).collect():
        got[r.query_id].append((r["rank"], r.id, r.score))
    vectors, hits = dict(enumerate(v)), 0
    for q in range(0, n, 50):
        want = exact(vectors, q)
        assert [r for r, *_ in sorted(got[q])] == list(range(1, 11))
        hits += len({i for _, i in want} & {i for _, i, _ in got[q]})
    assert hits / (10 * n / 50) >= 0.9


def test_rerank_budget_is_measured(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(3000, 32))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    for how in ({"candidates": 10}, {"probe_share": 0.02}):  # far too little: both have to grow
        hits, asked = 0, range(0, 3000, 100)
        for r in permutation_index.search(df, df.filter("vec_id % 100 = 0"), **how).collect():
            hits += r.id in np.argsort(((v - v[r.query_id]) ** 2).sum(1), kind="stable")[1:11]
        assert hits / (10 * len(asked)) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 1.0]) for i in range(30)] + [(30, None), (31, [0.0, 0.0]), (32, [nan, 1.0]), (33, [inf, 1.0]), (34, [None, 1.0]), (35, [1.0]), (36, [2.0, 1.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = permutation_index.search(df, df).collect()
    of = lambda q: [(r.id, r.score) for r in sorted((x for x in got if x.query_id == q), key=lambda x: x["rank"])]
    assert of(0) == [(i, 0.0) for i in range(1, 11)] and of(20) == [(i, 0.0) for i in range(10)]
    assert of(36)[0] == (0, 1.0) and not any(r.query_id in range(30, 36) or r.id in range(30, 36) for r in got)
    assert permutation_index.search(df.filter("vec_id < 3"), df.filter("vec_id = 0")).count() == 2
    assert permutation_index.search(df.limit(0), df.limit(0)).count() == 0


def brute_neighbours(rows, k=10):
    """Rows as they stand, each a candidate of its own but for those of the query's id; equal queries' ids by the smallest vector."""
    sound = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in sorted({i for i, _ in sound if i % 100 == 0}):
        own = min(v for i, v in sound if i == q)
        out[q] = [(i, round(d, 9)) for d, i in sorted((math.dist(own, v), i) for i, v in sound if i != q)[:k]]
    return out


def test_repeated_rows_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [rows[4]] * 3 + [rows[100]] * 15 + [(500 + k, rows[100][1]) for k in range(11)] + [(1000 + k % 3, rows[200][1]) for k in range(40)]
    rows += [(300, rng.normal(size=8).tolist()), (200, [0.0] * 8), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in permutation_index.search(df, df.filter("vec_id % 100 = 0"), probe_share=1.0, piece=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, round(r.score, 9)))
    assert dict(got) == brute_neighbours(rows)
    assert [i for i, d in got[100] if d == 0] == list(range(500, 510)) and [i for i, d in got[200] if d == 0] == [1000] * 10


def test_length_is_the_tables(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 20)] + [(100, [1.0]), (200, [2.0]), (300, [3.0]), (0, [0.5, 1.0]), (400, [9.2, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rid", F.lit(1)).withColumn("a.b", F.lit(1))
    got = permutation_index.search(df, df.filter("vec_id % 100 = 0"), k=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(0, 1), (0, 2), (400, 9), (400, 10)]
    alien = spark.createDataFrame([(7000, [5.1, 1.0])], "vec_id long, embedding array<double>")
    assert [r.id for r in permutation_index.search(df, alien, k=2).orderBy("rank").collect()] == [5, 6]


# quotations


def test_levels_and_passages():
    own, passages = quotation_linking.parsed("On Monday A wrote:\n> B wrote:\n> > deep\n> > words\n> first\n>\n> second\n\nmine\nmore\n")
    assert own == "mine\nmore" and passages == [(2, " deep\n words"), (1, " first"), (1, " second"), (0, "mine\nmore")]


def test_links_by_hand(spark):
    m = [
        (1, 0, "Hello there.\n\nSecond part."), (1, 1, "A wrote:\n> Hello   there.\n\nReply one."), (1, 2, "> > Hello there.\n> Reply one.\n\nDeeper."), (1, 3, "> Second part.\nTo the first."),
        (1, 4, "> never said\nLost."), (1, 5, None), (1, 6, ""), (2, 0, "> Reply one.\nOther thread."), (None, 1, "> Hello there."), (1, None, "> Hello there."), (1, 3, "> Second part.\nTo the first."),
    ]
    rows = spark.createDataFrame([(*x, "user") for x in m], "conv_id long, turn long, text string, role string")
    got = quotation_linking.conversations(rows).collect()
    assert len(got) == len(m)
    by = {(r.conv_id, r.turn): r for r in got}
    assert [by[1, t].parent_turn for t in range(7)] == [None, 0, 1, 0, None, None, None]
    assert [by[1, t].depth for t in range(4)] == [0, 1, 2, 1] and by[1, 2].root_turn == 0
    assert by[1, 2].own_text == "Deeper." and by[1, 5].own_text == "" and by[2, 0].parent_turn is None and by[1, 4].n_quoted == 1 and by[1, 4].n_linked == 0
    one = [r.turn for r in got if r.conv_id == 1 and r.root_turn == 0]
    assert one == sorted(one) and quotation_linking.conversations(rows.limit(0)).count() == 0


def test_unlike_messages_of_one_turn(spark):
    m = [(1, 0, "Start"), (1, 1, "> Start\nA"), (1, 1, "B, without a quote"), (1, 1, "B, without a quote"), (1, 2, "> B, without a quote\nC"), (1, 2, "> Start\nD"), (1, 3, "> C\nE")]
    got = quotation_linking.link(spark.createDataFrame([(*x, "u") for x in m], "conv_id long, turn long, text string, role string")).collect()
    told = sorted((r.own_text, r.n_quoted, r.n_linked, r.parent_turn, r.root_turn, r.depth) for r in got)
    b = ("B, without a quote", 0, 0, None, 1, 0)
    assert told == [("A", 1, 1, 0, 0, 1), b, b, ("C", 1, 1, 1, 0, 2), ("D", 1, 1, 0, 0, 1), ("E", 1, 1, 2, 0, 3), ("Start", 0, 0, None, 0, 0)]


def test_long_chain(spark):
    rows = spark.createDataFrame([(1, t, (f"> m{t - 1}\n" if t else "") + f"m{t}", "u") for t in range(40)], "conv_id long, turn long, text string, role string")
    assert all((r.root_turn, r.depth) == (0, r.turn) for r in quotation_linking.link(rows).collect())


def test_latest_earlier_holder(spark):
    m = [(1, 0, "Thanks"), (1, 1, "Other"), (1, 2, "Thanks"), (1, 3, "> Thanks\nYes"), (1, 5000, "> Thanks\nLate"), (1, 5001, "Thanks"), (1, 9000, "> thanks\nLast"), (1, 9000, "> thanks\nLast"), (1, -3, "> Thanks\nEarly")]
    got = quotation_linking.link(spark.createDataFrame([(*x, "u") for x in m], "conv_id long, turn long, text string, role string")).collect()
    assert {r.turn: r.parent_turn for r in got} == {0: None, 1: None, 2: None, 3: 2, 5000: 2, 5001: None, 9000: 5001, -3: None} and len(got) == len(m)


def test_only_line_feeds_end_lines(spark):
    text = "a\x0cb\x1cc\r\n\n\n\nd\u2028e"
    own, passages = quotation_linking.parsed(f"\n{text}\n> q\x0cr\r\n> s\nend\r\n")
    assert own == f"{text}\nend" and passages == [(0, "a\x0cb\x1cc"), (0, "d\u2028e"), (1, " q\x0cr\n s"), (0, "end")]
    turns = spark.createDataFrame([(1, 0, "u", text), (1, 1, "u", "b"), (1, 1, "u", "a"), (1, 2, "u", "c")], "conv_id long, turn long, role string, text string").withColumn("a.b", F.lit(1))
    got = quotation_linking.link(quotation_linking.as_mail(turns)).collect()
    assert {(r.turn, r.own_text, r.parent_turn) for r in got} == {(0, text, None), (1, "b", 0), (1, "a", 0), (2, "c", 1)}
    carried = quotation_linking.link(turns, ("role", "a.b"))
    assert carried.columns[2:4] == ["role", "a.b"] and carried.count() == 4


def brute_links(rows):
    """(conversation, turn, text) -> parent by turn, with loops and hashes of nothing."""
    plain = lambda x: " ".join(x.lower().split())

    def units(text):
        out, level, held = [], None, []
        lines = [x.removesuffix("\r") for x in (text or "").split("\n")]
        depth = [len(re.match(r"(?:[ \t]*>)*", x)[0].replace(" ", "").replace("\t", "")) for x in lines]
        for k, (line, n) in enumerate(zip(lines, depth)):
            body = re.sub(r"^(?:[ \t]*>)+", "", line) if n else line
            author = k + 1 < len(lines) and depth[k + 1] > n and body.strip().endswith("wrote:")
            if n != level or not body.strip() or author:
                out += [(level, held)] if held else []
                held, level = [], n
            if body.strip() and not author:
                held = [*held, body]
        out += [(level, held)] if held else []
        found = set()
        for level, held in out:
            found.add((level, 0, plain("\n".join(held))))
            found |= {(level, 1, plain(x)) for x in held} if len(held) > 1 else set()
        return found

    said = defaultdict(set)
    for c, t, x in rows:
        for level, _, u in units(x):
            if level == 0:
                said[c, u].add(t)
    parents = {}
    for c, t, x in rows:
        by_text = {}
        for level, kind, u in units(x):
            if level:
                by_text[u] = min(by_text.get(u, (99, 9)), (level, kind))
        links = [(*w, -max(p for p in said[c, u] if p < t)) for u, w in by_text.items() if any(p < t for p in said[c, u])]
        parents[c, t] = -min(links)[2] if links else None
    return parents


def test_whole_table(spark):
    mail = quotation_linking.as_mail(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    texts = {(r.conv_id, r.turn): r.text for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()}
    want = brute_links([(r.conv_id, r.turn, r.text) for r in mail.collect()])
    got = quotation_linking.conversations(mail).collect()
    assert {(r.conv_id, r.turn): r.parent_turn for r in got} == want
    for r in got:
        assert r.own_text == texts[r.conv_id, r.turn].strip("\r\n") and r.parent_turn == (r.turn - 1 if r.turn else None)
        up, depth = r.turn, 0
        while want[r.conv_id, up] is not None:
            up, depth = want[r.conv_id, up], depth + 1
        assert (r.root_turn, r.depth) == (up, depth)


# URL lists


def test_temporal_list_against_loops(spark):
    random.seed(9)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "c.net"]
    entries = [(random.choice(["a.com", "x.a.com", "com", "b.org", "A.com."]), f"2024-01-{random.randint(1, 28):02d}", random.choice(temporal_url_filter.ACTIONS)) for _ in range(40)]
    captures = [(i, f"https://{random.choice(hosts)}/p{i}", f"2024-01-{random.randint(1, 31):02d}") for i in range(300)]
    captures += [(300, None, "2024-01-05"), (301, "not a url", "2024-01-05"), (302, "http://c.net/", None), (303, "", None), (300, None, "2024-01-05")]
    e = spark.createDataFrame(entries + [(None, "2024-01-01", "block"), ("a.com", None, "block"), ("a.com", "2024-01-01", "odd")], "pattern string, s string, action string").selectExpr("pattern", "date(s) since", "action")
    c = spark.createDataFrame(captures, "page_id long, url string, t string").selectExpr("page_id", "url", "date(t) day", "1 as pattern", "2 as kept")
    rows = temporal_url_filter.judge(c, e, "page_id", "url", "day").collect()
    assert len(rows) == len(captures)
    order = {a: k for k, a in enumerate(temporal_url_filter.ACTIONS)}
    known = defaultdict(dict)
    for p, s, a in entries:
        p = p.lower().rstrip(".")
        if s not in known[p] or order[a] < order[known[p][s]]:
            known[p][s] = a
    for r in rows:
        found = None
        for p, dated in known.items():
            if r.host and r.fetched and (r.host == p or r.host.endswith("." + p)):
                past = [s for s in dated if s <= str(r.fetched)]
                if past and dated[max(past)] != "drop" and (found is None or len(p) > len(found[0])):
                    found = (p, dated[max(past)])
        assert (r.pattern, r.action) == (found or (None, None)) and r.kept == (r.host is not None and (found is None or found[1] != "block"))
    assert temporal_url_filter.judge(c, e.limit(0), "page_id", "url", "day").filter("kept").count() == 301


def test_hosts_of_odd_urls(spark):
    odd = {
        "http://my_site.example.com/a": "my_site.example.com", "http://münchen.de/": "münchen.de", "http://casino-win.example.com/a|b": "casino-win.example.com", "https://y.com/s?q=[x y]": "y.com", "https://x.com/{id}": "x.com",
        " HTTP://User:p@X.com.:80?q ": "x.com", "http://[::1]:80/": "[::1]", "http://a.b#c@d": "a.b", "http:///x": None, "not a url": None, "": None, None: None,
    }
    c = spark.createDataFrame([(u, "2024-02-01") for u in odd], "url string, t string").selectExpr("url AS page_id", "url", "date(t) day")
    e = spark.createDataFrame([("casino-win.example.com", "2024-01-15", "block")], "pattern string, s string, action string").selectExpr("pattern", "date(s) since", "action")
    rows = temporal_url_filter.judge(c, e, "page_id", "url", "day").collect()
    assert {r.page_id: r.host for r in rows} == odd
    assert {r.host for r in rows if not r.kept} == {None, "casino-win.example.com"}


def test_hot_host_is_dealt(spark):
    captures = spark.range(6000).selectExpr("id page_id", "concat('https://', CASE WHEN id % 3 = 0 THEN 'hot.com' ELSE concat('h', id % 500, '.org') END, '/p', id) url", "date_add(date'2024-01-01', int(id % 60)) day", "1 AS _k", "1 AS `a.b`")
    e = spark.createDataFrame([("hot.com", "2024-01-10", "block"), ("hot.com", "2024-02-01", "drop"), ("org", "2024-02-05", "block")], "pattern string, s string, action string").selectExpr("pattern", "date(s) since", "action")
    got = temporal_url_filter.judge(captures, e, "page_id", "url", "day").collect()
    assert sorted(r.page_id for r in got) == list(range(6000))
    for r in got:
        day = r.page_id % 60
        blocked = 9 <= day < 31 if r.page_id % 3 == 0 else day >= 35
        assert r.kept == (not blocked) and (r.pattern is None) == r.kept


# near-duplicates


def place_of(text):
    """Spark's XXH64 of a text, signed; of null the seed."""
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), 42) if text is not None else 42
    return h - (1 << 64) if h >> 63 else h


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_fingerprints(spark):
    texts = [None, "", " \n", "One", "One Two", "ÀB c D e f", "a b c " * 9000]
    assert [simhash_slices.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] & (1 << 64) - 1 == simhash_slices.fingerprint("a b c")


def test_bit_slices_count_right():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**32, 30, dtype=np.uint64)
    v = np.array([int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 32, (20, 2))], np.uint32)
    n = len(v)
    for radius in (0, 2, 3):
        got = {(int(a), int(b)) for i, j in simhash_slices.within(v, 32, np.arange(n) + 1, np.full(n, n), radius) for a, b in zip(i, j)}
        assert got == {(a, b) for a in range(n) for b in range(a + 1, n) if (int(v[a]) ^ int(v[b])).bit_count() <= radius}


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_links_lose_nothing(spark):
    rng = random.Random(4)
    fps = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(30):
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = union(len(fps), [(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if (fps[a] ^ fps[b]).bit_count() <= 2])
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    place = {x: k for k, x in enumerate(signed)}
    for chunk in (5, 2048):
        pairs = [(place[r.u], place[r.v]) for r in simhash_slices.links(nodes, chunk).collect()]
        assert union(len(fps), pairs) == want


def test_groups_of_documents(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(400)) for _ in range(8)]
    rows = [(k, t) for k, t in enumerate(base)] + [(100 + k, base[0]) for k in range(20)] + [(200 + k, base[1] + f" end{k}") for k in range(5)] + [(300, None), (301, ""), (None, base[2]), (7, base[3])]
    docs = spark.createDataFrame([(*x, "en", "s", 1) for x in rows], DOCS)
    got = simhash_slices.near_duplicates(docs).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    root = union(len(rows), [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if (fps[a] ^ fps[b]).bit_count() <= 2])
    least = defaultdict(lambda: 1 << 40)
    for (i, _), r in zip(rows, root):
        least[r] = min(least[r], i if i is not None else 1 << 40)
    want = sorted((i if i is not None else -1, f, least[r]) for (i, _), f, r in zip(rows, fps, root))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fp & (1 << 64) - 1, r.component_id) for r in got) == want
    kept = simhash_slices.deduplicated(docs)
    odd = docs.withColumnsRenamed({"lang": "a.b", "source": "fp", "n_chars": "place"})
    assert simhash_slices.deduplicated(odd).columns == odd.columns and simhash_slices.deduplicated(odd).count() == kept.count()
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert simhash_slices.near_duplicates(docs.limit(0)).count() == 0


def test_one_document_of_each_group_without_ids(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(60)) for _ in range(9)]
    rows = [(None, t) for t in base[:6]] + [(None, base[0]), (5, base[1]), (7, base[6]), (7, base[7]), (8, base[8]), (8, base[8]), (8, base[8])]
    docs = spark.createDataFrame([(*x, "en", "s", 1) for x in rows], DOCS)
    kept = [(r.doc_id, r.text) for r in simhash_slices.deduplicated(docs.repartition(3)).collect()]
    assert sorted(kept, key=str) == sorted([(None, base[k]) for k in (0, 2, 3, 4, 5)] + [(5, base[1]), (7, base[6]), (7, base[7]), (8, base[8])], key=str)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, k) for k in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = union(400, edges)
    assert got == {n: want[n] for e in edges if e[0] != e[1] for n in e}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# mixture


def test_targets_by_hand(spark):
    s = spark.createDataFrame([("sa", 100), ("sb", 1000), ("sc", 1000), ("z", 0)], "key string, source_size long")
    t = {r.key: r.target for r in curriculum_mix.targets(s).collect()}
    # weights 5, 2, 1, 5 share 3150 words: a and the empty source stop, b stops at its cap once c's share is known
    assert t["sa"] == 200 and t["z"] == 0 and math.isclose(t["sb"], 2950 * 2 / 3) and math.isclose(t["sc"], 2950 / 3)


def loops_mix(rows):
    import hashlib

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((hashlib.md5(str(i).encode()).hexdigest(), i, size(t)))
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(x[2] for x in by[s]) for s in order}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(total.values()), set(order), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= over
        if not open_:
            break
    target.update({s: share[s] for s in open_})
    return {s: (total[s], target[s]) for s in order}


def test_mix_against_loops(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rng.choice((0, 3, 50, 400)))), rng.choice(["b", "a", None, "é", "B", "b", "b"])) for i in range(400)] + [(400, None, "a"), (401, "x", "only"), (5, "again again", "b")]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], DOCS)
    got = curriculum_mix.mix(docs).collect()
    want, taken = loops_mix(rows), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == want[r.source][0] and math.isclose(r.target, want[r.source][1], rel_tol=1e-12)
        assert 0 <= r.taken <= 2 * r.size and r.positions == sorted(r.positions) and all(0 <= p <= 1 for p in r.positions) and len(r.positions) == r.copies
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s][1]) <= 1 for s in want)
    assert sorted(map(str, got)) == sorted(map(str, curriculum_mix.mix(docs.repartition(7)).collect()))
    ordered = curriculum_mix.training_order(docs)
    odd = docs.withColumnsRenamed({"lang": "a.b", "n_chars": "size"})
    assert curriculum_mix.training_order(odd).columns == odd.columns and curriculum_mix.training_order(odd).count() == ordered.count()
    assert ordered.columns == docs.columns and curriculum_mix.mix(docs.limit(0)).count() == 0
    words = defaultdict(int)
    for r in ordered.collect():
        words[r.source] += len((r.text or "").split())
    assert dict(words) == {s: n for s, n in taken.items() if n}


def test_mix_of_rows_without_ids_and_of_long_texts(spark):
    rows = [(None, "w " * (k % 7), "en", "a", 1) for k in range(60)] + [(3, f"t{k} x y z", "en", "a", 1) for k in range(30)] + [(4, "long " * 50_000, "en", "b", 1)] + [(5, "same same", "en", "b", 1)] * 4
    docs = spark.createDataFrame(rows, DOCS)
    got = curriculum_mix.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    cut = sorted(map(str, curriculum_mix.training_order(docs).collect()))
    assert cut == sorted(map(str, curriculum_mix.training_order(docs.repartition(5)).collect()))


def test_demand_is_inverted(spark):
    d = spark.range(0, 101).select((F.col("id") / 100).alias("u"))
    for turn, knots in enumerate(curriculum_mix.SCHEDULES):
        for r in d.select("u", curriculum_mix.due(F.col("u"), F.lit(turn)).alias("t")).collect():
            grid = np.linspace(0, 1, 20001)
            w = np.interp(grid, *zip(*knots))
            area = np.concatenate(([0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(grid))))
            assert math.isclose(np.interp(r.t, grid, area) / area[-1], r.u, abs_tol=1e-6)


def test_first_words(spark):
    d = spark.createDataFrame([("  a b\n\nc  d ",)], "t string")
    assert [d.select(curriculum_mix.first_words(F.col("t"), F.lit(n))).first()[0] for n in (1, 3, 4)] == ["  a", "  a b\n\nc", "  a b\n\nc  d"]


# pipeline


def naive_language(crf, text):
    """(label, mean probability) by forward-backward in logarithms, word by word."""
    words = crf_language.words_of(text)
    if not words:
        return "und", 0.0
    k = len(crf.langs)
    own = []
    for w in words:
        slots = crf_language.features([w], len(crf.weights))[0]
        own.append(crf.weights[slots].sum(0, dtype=float) + sum(crf.lexicon_weights[y].astype(float) for y in crf.lexicon.get(w, ())) + np.zeros(k))
    add = lambda m: np.logaddexp.reduce(m, axis=0)
    fore = [own[0]]
    for s in own[1:]:
        fore.append(add(fore[-1][:, None] + crf.transitions) + s)
    back = [np.zeros(k)]
    for s in own[:0:-1]:
        back.append(add((crf.transitions + (s + back[-1])[None, :]).T))
    p = np.array([f + b for f, b in zip(fore, back[::-1])])
    mean = np.exp(p - np.logaddexp.reduce(p, axis=1)[:, None]).mean(0)
    return crf.langs[int(mean.argmax())], float(mean.max())


def naive_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, triples = len(words), [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {t for t, c in Counter(triples).items() if c > 1}
    repeated = len({i + k for i, t in enumerate(triples) if t in many for k in range(3)})
    if n < 50 or 100 * repeated > 50 * n:
        return False
    share = lambda xs, of: len(list(xs)) / len(of) if of else 0.0
    figures = {
        "mean_word_length": sum(map(len, words)) / n, "symbol_ratio": sum((text or "").count(c) for c in quality_rules.SYMBOLS) / n,
        "stop_word_ratio": share((w for w in words if w.lower() in quality_rules.STOP_WORDS), words), "letter_word_ratio": share((w for w in words if any(c.isalpha() for c in w)), words),
        "dup_line_ratio": (len(lines) - len(set(lines))) / len(lines), "bullet_line_ratio": share((x for x in lines if re.match(r"[\x20\x09]*[-*•]", x)), lines), "ellipsis_line_ratio": share((x for x in lines if re.search(r"(\.\.\.|…)[\x20\x09\x0D]*$", x)), lines),
    }
    return all(figures[r.measure] >= r.bound if r.relation == ">=" else figures[r.measure] <= r.bound for r in quality_rules.RULES)


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage from its predecessor's rows, with loops; copies of the mix by its targets, words and order of digests."""
    import hashlib

    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = docs.limit(6).withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.limit(4)).unionByName(spark.createDataFrame([(9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, "... 123", "en", "s", 7)], DOCS))
    docs = docs.unionByName(more)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    crf = crf_language.train(docs)
    told = [naive_language(crf, r[1]) for r in rows]
    rows = [r for r, (label, p) in zip(rows, told) if label != "und" and p >= crf_language.LEAST_SCORE]
    rows = [r for r in rows if naive_quality(r[1])]
    fps = [brute_fingerprint(r[1]) for r in rows]
    group = union(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    first = {}
    for g, r in zip(group, rows):
        key = (r[0] is None, r[0] or 0, place_of(r[1]))
        first[g] = min(first.get(g, (key, r)), (key, r))
    rows = [r for _, r in first.values()]
    plan = loops_mix([(r[0], r[1], r[3]) for r in rows])
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    want = Counter()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    for source, (total, target) in plan.items():
        stream = sorted((md5(f"{'' if r[0] is None else r[0]}|{md5(r[1] or '')}"), r) for r in rows if r[3] == source)
        whole, at = int(target // total), 0
        rest = round(target - whole * total)
        for _, r in stream:
            ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", r[1])]
            take = min(max(rest - at, 0), len(ends))
            for text in [r[1]] * whole + ([r[1][: ends[take - 1]]] if take else []):
                ids = tokenizer.encode(text, add_special_tokens=False).ids
                want[r[0], len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()] += 1
            at += len(ends)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in out)
    assert got == want and sum(got.values()) > 100
    # files and rows hold the training order
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = shared.written(stage(spark, docs, ""), name)
    due = {r.doc_id: r.positions for r in curriculum_mix.mix(docs).collect() if r.doc_id is not None}
    order = [r.doc_id for r in sorted(out, key=lambda r: (r.file, r.row)) if r.doc_id is not None]
    nth, times = Counter(), []
    for i in order:
        times.append(due[i][nth[i]])
        nth[i] += 1
    assert times == sorted(times) and len(set(times)) > 50


def test_stages_keep_odd_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("a.b", F.lit(1)).withColumn("row", F.lit("x")).withColumn("kept", F.lit(False))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    coded = corpus_pipeline.encoding(spark, docs, "")
    assert coded.count() == docs.count() > 50 and coded.filter("file IS NOT NULL").count() == 0


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(spark.createDataFrame([(9000, None, None, None, None), (9001, "", "en", "s", 0)], DOCS))
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, "").collect()
        docs = spark.createDataFrame(rows, docs.schema)
        sizes.append(len(rows))
    assert sizes[0] == 200 and sizes[0] > sizes[1] >= sizes[2] and docs.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    out = corpus_pipeline.encoding(spark, docs, "")
    assert out.count() == sizes[-1] and out.filter("n_tokens = 0").count() == 0
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


# the shared folder


def test_no_machine_local_folder_on_a_cluster():
    class Unset:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Unset()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())


def test_clear_removes_this_applications_tables(spark):
    import os

    shared.written(spark.range(3), "x")
    own = shared._own_dir(spark).removeprefix("file:")
    assert os.listdir(own)
    shared.clear(spark)
    assert not os.path.exists(own)
