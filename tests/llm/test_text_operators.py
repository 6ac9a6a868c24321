"""Operators on documents against brute force, on edge cases and on the smallest tables."""

import random

import brute
import pytest
from brute import as_docs, edge_rows
from pyspark.sql import functions as F

from dockpulse.llm import decontamination, lines, simhash, suffix_sort, suffix_tree


def same(found, expected):
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def tuples(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.fixture(scope="module")
def rows():
    return edge_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return as_docs(spark, rows)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_line_dedup(docs, rows, none):
    found = lines.with_kept_lines(docs).select(
        "document.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)
    )
    same([tuple(r) for r in found.collect()], brute.lines(rows))
    assert lines.with_kept_lines(none).count() == 0


def test_line_bitmaps_hold_dropped_lines_only(spark):
    line = "x" * 30
    text = "\n".join(["keep"] * 70 + [line] + ["keep"] * 70)
    docs = spark.createDataFrame([(i, text) for i in (1, 2, 3)], "doc_id long, text string")
    maps = {r.doc_id: r.words for r in lines.drop_bitmaps(docs).collect()}
    assert maps == {1: {1: 1 << 6}, 2: {1: 1 << 6}}


def test_documents_without_repeated_lines_keep_their_columns(docs, rows):
    kept = lines.without_repeated_lines(docs)
    assert kept.columns == docs.columns
    assert {r.key for r in kept.select("key").distinct().collect()} == {"kept"}
    texts = {(r.doc_id, r.text) for r in kept.collect()}
    assert (14, "A line of text that several documents repeat") in texts
    assert (1, None) in texts and (2, "") in texts
    gone = [i for i, n, dropped, _ in brute.lines(rows) if n == dropped]
    assert kept.count() == len(rows) - len(gone)


@pytest.mark.parametrize("group", [1, suffix_sort.GROUP])
def test_suffix_sort(docs, rows, group):
    found = suffix_sort.without_repeats(docs, group=group)
    same(
        tuples(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"),
        brute.repeated_bytes(rows),
    )


def test_suffix_sort_of_short_strings(spark):
    rows = [(1, "abcabcab"), (2, "xxabcax"), (3, "é"), (4, "zzzzzzz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_sort.without_repeats(docs, length=4, gram=2)
    same(
        tuples(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"),
        brute.repeated_bytes(rows, 4),
    )


@pytest.mark.parametrize("group", [1, suffix_tree.GROUP])
def test_suffix_tree(docs, rows, group):
    found = suffix_tree.without_repeats(docs, group=group)
    same(tuples(found, "doc_id", "n_words", "n_removed", "kept"), brute.earlier_passages(rows))


def test_repeats_of_an_empty_table(none):
    assert suffix_sort.without_repeats(none).count() == 0
    assert suffix_tree.without_repeats(none).count() == 0


def test_long_texts_are_read_in_parts(spark, monkeypatch):
    from dockpulse.llm import windows

    monkeypatch.setattr(windows, "SEGMENT", 2048)
    rows = [(i, t) for i, t in edge_rows() if i in (5, 6, 8, 9, 15, 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_sort.without_repeats(docs)
    same(
        tuples(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"),
        brute.repeated_bytes(rows),
    )
    found = suffix_tree.without_repeats(docs)
    same(tuples(found, "doc_id", "n_words", "n_removed", "kept"), brute.earlier_passages(rows))


def test_common_extensions_survive_hash_collisions():
    class Blind(suffix_sort.W.Powers):
        def prefixes(self, values, which):
            return super().prefixes(values * 0, which)

    powers = Blind(100)
    values = suffix_sort.W.symbol_values(256, 1)
    a, b = (suffix_sort.Suffix(t, values, powers) for t in (b"x" * 40 + b"a", b"x" * 7 + b"y" * 34))
    assert suffix_sort.verified_extension(a, b) == 7


def test_simhash(docs, rows, none):
    found = simhash.near_duplicates(docs)
    prints = [(i, brute.simhash(t)) for i, t in rows]
    expected = [(i, f - (f >> 63 << 64), c) for i, f, c in brute.near_components(prints)]
    same(tuples(found, "doc_id", "fp", "component_id"), expected)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("chunk", [2, 1024])
def test_links_of_crowded_cells(spark, monkeypatch, chunk):
    """Many fingerprints around one centre: no link is lost, and far fewer than all pairs come."""
    import random

    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(20)}
    centre = rng.getrandbits(64)
    for _ in range(60):
        prints.add(centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(4))}))
    prints = sorted(prints)
    signed = [(i, p - (p >> 63 << 64)) for i, p in enumerate(prints)]
    fps = spark.createDataFrame(signed, "doc_id long, fp long")
    links = simhash.links(fps.select("fp"))
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    classes = {}
    for i, p in signed:
        classes.setdefault(roots.get(p, p), set()).add(i)
    expected = {}
    for i, _, component in brute.near_components(list(enumerate(prints))):
        expected.setdefault(component, set()).add(i)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, expected.values()))


def test_embedding_is_a_lower_bound():
    import numpy as np

    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 63, (2, 500)).astype(np.uint64)
    ca, cb = (simhash._segment_counts(x) for x in (a, b))
    for x, y, p, q in zip(a, b, ca, cb):
        manhattan = sum(abs((int(p) >> s & 3) - (int(q) >> s & 3)) for s in range(0, 64, 2))
        assert manhattan <= (int(x) ^ int(y)).bit_count()


def test_one_of_each_group_stays(docs, rows):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 5 in ids and 7 not in ids and 2 not in ids and 1 in ids
    prints = [(i, brute.simhash(t)) for i, t in rows]
    components = {c for *_, c in brute.near_components(prints)}
    assert set(ids) == components


ITEMS = [
    (1, "alpha beta gamma delta one two three four five six seven eight"),
    (2, "Short item, here!"),
    (3, "short item here and then some more words follow it up to ten words"),
    (None, "one two three four five six seven eight nine ten"),
    (4, ""),
    (5, None),
    (5, "θήτα Épsilon"),
    (6, "a"),
]
TEXTS = [
    (1, "x ALPHA beta-gamma delta one two three four five six seven eight nine ten eleven"),
    (2, "a short item. here and then"),
    (3, "short item her"),
    (4, None),
    (5, ""),
    (6, "θήτα Épsilon θήτα Épsilon"),
    (7, "two three four five six seven eight nine ten"),
    (7, "one two three four five six seven eight nine ten"),
    (None, "SHORT ITEM HERE"),
    (8, "clean text of no concern"),
]


@pytest.mark.parametrize("shard_words", [4, 1000])
def test_contamination(spark, shard_words):
    docs = as_docs(spark, TEXTS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontamination.contamination(docs, items, shard_words=shard_words)
    same(tuples(found, "doc.doc_id", "n_words", "n_hit", "items"), brute.contamination(TEXTS, ITEMS))
    nothing = decontamination.contamination(docs, items.limit(0))
    assert {r.n_hit for r in nothing.collect()} == {0}
    assert decontamination.contamination(docs.limit(0), items).count() == 0


def test_random_contamination(spark):
    import random

    rng = random.Random(5)

    def text(n):
        return " ".join(rng.choice("abc") for _ in range(n))

    items = [(i, text(rng.randrange(1, 25))) for i in range(12)]
    texts = [(i, text(rng.randrange(0, 80))) for i in range(40)]
    found = decontamination.contamination(
        spark.createDataFrame(texts, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
        window=6,
    )
    same(tuples(found, "doc.doc_id", "n_words", "n_hit", "items"), brute.contamination(texts, items, 6))


def test_decontaminated_documents(spark):
    docs = as_docs(spark, TEXTS)
    items = spark.createDataFrame(ITEMS[:3], "item_id long, text string")
    found = decontamination.decontaminate(docs, items, max_coverage=0.8)
    assert found.columns == docs.columns
    kept = {r.doc_id: (r.text, r.n_chars) for r in found.where("doc_id <> 7").collect()}
    assert kept[1] == ("x  nine ten eleven", 18)
    assert kept[4] == (None, 0) and kept[8][0] == "clean text of no concern"
    assert found.where("doc_id is null").count() == 0, "covered as a whole"


@pytest.mark.parametrize("shared", [None, 7])
def test_repeats_among_a_thousand_rows_of_one_id(spark, shared):
    """Rows that share an id, or have none, are told apart by their whole texts."""
    rng = random.Random(11)
    passage = " ".join("p%d" % rng.randrange(500) for _ in range(110))
    rows = []
    for i in range(1000):
        own = " ".join("w%d" % rng.randrange(10_000) for _ in range(rng.randrange(5, 40)))
        text = f"{own} {passage} end{i}" if i % 9 == 0 else own
        rows.append((shared if i % 10 else i, text))
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = suffix_sort.without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    same([tuple(r) for r in found.collect()], brute.repeated_bytes(rows))
    found = suffix_tree.without_repeats(docs)
    same([tuple(r) for r in found.collect()], brute.earlier_passages(rows))
