"""Set join, hard negatives and lexical search against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import as_docs, edge_rows
from pyspark.sql import functions as F

from dockpulse.llm import hard_negatives, lexical, signature_join

PLAIN = "doc_id long, text string"


def same(found, expected):
    assert sorted(found, key=repr) == sorted(expected, key=repr)


# -- set join --------------------------------------------------------------------------------


def brute_join(rows, shingle=5, percent=80):
    """(doc_id, set size, component id) of each (doc_id, text)."""

    def parts(text):
        words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        return {tuple(words[p : p + shingle]) for p in range(max(len(words) - shingle + 1, 1))} if words else set()

    sets = [parts(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * len(sets[a] | sets[b]) > 0:
                parent[root(a)] = root(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[root(x)] = min(least.get(root(x), i), i)
    return [(i, len(s), least.get(root(x)) if s else i) for x, ((i, _), s) in enumerate(zip(rows, sets))]


def near_copies(seed):
    """Texts with copies around the limit, short texts, crowded families and a common passage."""
    rng = random.Random(seed)
    passage = ["p%d" % i for i in range(40)]
    rows = []
    for _ in range(30):
        text = ["w%d" % rng.randrange(400) for _ in range(rng.choice([3, 6, 9, 12, 30, 90, 180]))]
        if rng.random() < 0.5:
            text = text + passage
        rows.append(text)
        for _ in range(3):
            copy = list(text)
            for _ in range(rng.randrange(1, 2 + len(text) // 25)):
                copy[rng.randrange(len(copy))] = "x%d" % rng.randrange(9)
            rows.append(copy[rng.randrange(3) :])
    family = ["c%d" % i for i in range(90)]
    for i in range(50):
        copy = list(family)
        for sign in "yz"[: rng.randrange(1, 3)]:
            copy[rng.randrange(90)] = f"{sign}{i}"
        rows.append(copy)
    rng.shuffle(rows)
    return [(i, " ".join(t)) for i, t in enumerate(rows)]


@pytest.mark.parametrize("sizes", [{}, {"chunk_hashes": 150, "part_hashes": 64}])
def test_set_join(spark, sizes):
    for rows in (near_copies(4), edge_rows()):
        found = signature_join.similar_sets(as_docs(spark, rows), **sizes)
        same([tuple(r) for r in found.collect()], brute_join(rows))


@pytest.mark.parametrize("percent", [60, 95])
def test_set_join_at_other_limits(spark, percent):
    rows = near_copies(7)
    found = signature_join.similar_sets(spark.createDataFrame(rows, PLAIN), shingle=2, percent=percent)
    same([tuple(r) for r in found.collect()], brute_join(rows, 2, percent))


def test_set_join_of_nothing_and_of_one_text_only(spark):
    docs = spark.createDataFrame([(i or None, "one and the same text " * 9) for i in range(300)], PLAIN)
    assert signature_join.similar_sets(docs.limit(0)).count() == 0
    found = signature_join.similar_sets(docs).select("component_id").distinct().collect()
    assert [r.component_id for r in found] == [1]


def test_nodes_are_left_only_where_no_pair_below_could_link():
    rng = np.random.default_rng(5)
    pool = rng.integers(-(1 << 62), 1 << 62, 300)
    sizes = [rng.integers(*((5, 9) if i % 2 else (50, 60))) for i in range(1300)]
    sets = [np.unique(rng.choice(pool, n)) for n in sizes]
    widths = [128, 256]
    members = [
        signature_join.Member(i, i, len(s), signature_join.signature(s, widths[i % 2]), s)
        for i, s in enumerate(sets)
    ]
    tree = signature_join.SignatureTree(members, 256)
    nodes = [tree.root]
    for node in nodes:
        nodes += node.children
    for a in nodes:
        for b in nodes:
            if signature_join.apart(a, b, 80):
                for i in range(a.begin, a.end):
                    for j in range(b.begin, b.end):
                        x, y = tree.members[i].hashes, tree.members[j].hashes
                        assert not signature_join.links_with(len(np.intersect1d(x, y)), len(x), len(y), 80)
    assert any(signature_join.apart(a, b, 80) for a in nodes if a.children for b in nodes if b.children)


# -- hard negatives --------------------------------------------------------------------------


def brute_negatives(rows, every=10, positives=5, negatives=10):
    sound = [
        (i, label, [math.floor(256 * x) for x in v])
        for i, v, label in rows
        if i is not None and label is not None and v is not None
        and all(x is not None and math.isfinite(x) for x in v)
    ]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for a, (anchor, label, v) in enumerate(sound):
        if anchor % every:
            continue
        ranked = sorted((-score(v, w), i, b) for b, (i, _, w) in enumerate(sound) if b != a)
        for minus, positive, _ in [r for r in ranked if sound[r[2]][1] == label][:positives]:
            fit = [r for r in ranked if sound[r[2]][1] != label and -30 * minus <= -100 * r[0] <= -90 * minus]
            out += [(anchor, positive, k, i, -minus, -s) for k, (s, i, _) in enumerate(fit[:negatives], 1)]
    return out


def vectors(seed, n=400, dims=7):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(n):
        label = rng.randrange(4)
        v = [x + rng.gauss(0, 0.6) for x in centres[rng.randrange(6)]]
        rows.append((i, v, label))
    rows += [(10, rows[10][1], rows[10][2])] * 2 + [(500 + i, rows[3][1], 1) for i in range(90)]
    rows += [(610, None, 1), (620, rows[0][1], None), (None, rows[0][1], 1), (630, [float("nan")] * dims, 2)]
    rows += [(640, [None] * dims, 2), (650, [float("inf")] + [0.0] * (dims - 1), 0), (660, [0.0] * dims, 0)]
    rows += [(670, rows[5][1][:3], 2), (680, [], 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("settings", [{}, {"shard_rows": 60, "codes": 5}, {"shard_rows": 7, "sample": 3}])
def test_hard_negatives(spark, settings):
    rows = vectors(3)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for name in ("ref", "score", "rank", "shard", "window"):
        table = table.withColumn(name, F.lit("kept"))
    found = hard_negatives.hard_negatives(table.repartition(3), lambda i: i % 10 == 0, **settings)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = brute_negatives(rows)
    assert len(expected) > 500
    same([tuple(r) for r in found.collect()], expected)
    assert hard_negatives.hard_negatives(table.limit(0), lambda i: i % 10 == 0).count() == 0


def test_cells_come_by_falling_bounds_and_stop_early():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 300, (8, 6))
    points = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(0, 5, (800, 6))).astype(np.int64)
    ids = np.arange(800)
    books = tuple(hard_negatives.codebook(points[:, h].astype(float), 8) for h in (slice(0, 3), slice(3, 6)))
    index = hard_negatives.MultiIndex(ids, ids, ids % 2, points, books)
    query = points[5]
    visited = list(index.visit(query))
    assert sum(end - begin for _, begin, end in visited) == 800
    assert [b for b, *_ in visited] == sorted((b for b, *_ in visited), reverse=True)
    for bound, begin, end in visited:
        assert index.scores(begin, end, query).max() <= bound
    seen = []
    index.scores = lambda begin, end, q, exact=index.scores: seen.append(end - begin) or exact(begin, end, q)
    window = hard_negatives.ScoreWindow(None, None, 5)
    hard_negatives.search(index, query, np.ones(800, bool), [window])
    assert sorted(window.scores)[::-1] == sorted(points @ query)[::-1][:5]
    assert sum(seen) < 700


# -- lexical search --------------------------------------------------------------------------


def brute_search(rows, items, top):
    def terms(text):
        folded = (text or "").translate({c: c + 32 for c in range(65, 91)})
        return Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded))

    docs = [(i, terms(t)) for i, t in rows if terms(t)]
    total, words = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in docs:
            m = 75 + (25 * sum(c.values()) * total) // words
            score = sum(
                n * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t, n in terms(text).items()
                if t in c
            )
            if score > 0:
                scored.append((-score, i is None, i))
        for rank, (minus, _, i) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:top], 1):
            out.append((item, rank, i, -minus))
    return out


@pytest.mark.parametrize("settings", [{}, {"top": 3, "shard": 7}, {"top": 1, "shard": 5, "block_bytes": 300}])
def test_lexical_search(spark, settings):
    rng = random.Random(8)
    rows = edge_rows() + [(i, t) for i, t in near_copies(3)]
    items = [(1, "alpha1 beta2 alpha1 w7"), (2, None), (3, ""), (None, "THE of c3 w9"), (4, "nothing-known")]
    items += [(4, "c1 c2 c3 p4 the the"), (5, "p1 p2 p3"), (6, "Épsilon4 épsilon4 zeta5 eta.7")]
    for i in range(20):
        text = rng.choice(rows)[1] or ""
        items.append((7 + i, " ".join(rng.sample(text.split(), min(9, len(text.split()))))))
    queries = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'k' AS query", "'k' AS rank")
    found = lexical.search(as_docs(spark, rows), queries, **settings)
    expected = brute_search(rows, items, settings.get("top", 20))
    assert len(expected) > 20
    same([tuple(r) for r in found.collect()], expected)
    assert lexical.search(as_docs(spark, rows).limit(0), queries).count() == 0
    assert lexical.search(as_docs(spark, rows), queries.limit(0)).count() == 0


def test_accumulators_stop_where_untouched_documents_cannot_win():
    """The common last term is not worth an accumulator, but still adds to those that exist."""
    bounds = np.array([0, 30, 130])
    docs = np.concatenate([np.arange(30), np.arange(100)])
    parts = np.concatenate([np.full(30, 1000), np.full(100, 10)])
    found, scores = lexical.accumulate(np.array([0, 1]), np.array([1, 1]), (bounds, docs, parts), 100, 20, 0)
    assert found.tolist() == list(range(30)) and set(scores.tolist()) == {1010}
    by_term = defaultdict(int)
    for floor in (0, 5, 2000):
        by_term[floor] = len(lexical.accumulate(np.array([1]), np.array([1]), (bounds, docs, parts), 100, 20, floor)[0])
    assert by_term == {0: 100, 5: 100, 2000: 0}
