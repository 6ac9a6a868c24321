"""Removal of word passages that an earlier document has, by prefix-partitioned suffix trees.

Every word covered by ``LENGTH`` consecutive words that also start in a document with a smaller
doc_id is removed. ``windows`` partitions the suffixes: those that can matter are grouped by a
prefix of two words at their anchor, and where a group would not fit in memory, by a prefix of
the whole window, which needs no tree any more. For each remaining group a suffix tree is built
from its sorted suffixes; its deep internal nodes, those of at least ``LENGTH`` words that have no
such node above them, are the repeats, and every suffix below one but those of the smallest
document is a passage to remove.

Defined results: a null text has no words; a null doc_id counts as smaller than all others; rows
that share a doc_id remove nothing from one another; texts of fewer words keep everything; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import (
    BinaryType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from dockpulse.llm import windows as W
from dockpulse.llm.common import map_arrow
from dockpulse.llm.suffix_sort import groups_by_key, runs_of

LENGTH = 13
GRAM = 2
#: Contexts whose suffixes make one tree at most.
GROUP = 16384

_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_CONTEXTS = StructType(
    [
        StructField("key", LongType()),
        StructField("id", LongType()),
        StructField("wide", LongType()),
        StructField("place", LongType()),
        StructField("symbols", BinaryType()),
    ]
)
_SPANS = StructType([StructField(n, LongType()) for n in ("id", "wide", "place")])


class Node:
    """Internal node: suffixes first..last of the sorted order share ``depth`` words."""

    __slots__ = ("depth", "first", "last", "children")

    def __init__(self, depth: int, first: int):
        self.depth, self.first, self.last = depth, first, first
        self.children: list[Node] = []


def shared_words(a: list[bytes], b: list[bytes]) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def suffix_tree(ordered: list[list[bytes]]) -> Node:
    """The internal nodes over sorted suffixes, by a stack of those that are still open."""
    root = Node(0, 0)
    path = [root]
    for i in range(1, len(ordered)):
        depth = shared_words(ordered[i - 1], ordered[i])
        below, first = None, i - 1
        while path[-1].depth > depth:
            below = path.pop()
            below.last, first = i - 1, below.first
            if path[-1].depth >= depth:
                path[-1].children.append(below)
        if path[-1].depth < depth:
            node = Node(depth, first)
            if below is not None:
                node.children.append(below)
            path.append(node)
    while len(path) > 1:
        node = path.pop()
        node.last = len(ordered) - 1
        path[-1].children.append(node)
    root.last = len(ordered) - 1
    return root


def deep_nodes(root: Node, depth: int) -> Iterator[Node]:
    """Nodes of at least ``depth`` words below shallower ones."""
    open_nodes = [root]
    while open_nodes:
        node = open_nodes.pop()
        if node.depth >= depth:
            yield node
        else:
            open_nodes += node.children


def repeated_windows(
    contexts: list[tuple[int, list[bytes], int]], length: int
) -> list[np.ndarray]:
    """For each (id, words, windows): which windows a context of a smaller id has too."""
    leaves = [
        (words[at:], doc, number, at)
        for number, (doc, words, count) in enumerate(contexts)
        for at in range(count)
    ]
    leaves.sort(key=lambda leaf: leaf[0])
    marks = [np.zeros(count, bool) for _, _, count in contexts]
    if len(leaves) > 1:
        for node in deep_nodes(suffix_tree([leaf[0] for leaf in leaves]), length):
            below = leaves[node.first : node.last + 1]
            least = min(doc for _, doc, _, _ in below)
            for _, doc, number, at in below:
                if doc > least:
                    marks[number][at] = True
    return marks


def word_bounds(octets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end."""
    blank = np.concatenate([[True], _BLANK[octets], [True]])
    return np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])


def _parts(body: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """(first word, text): long texts in parts that share ``length - 1`` words."""
    if len(body) <= 2 * W.SEGMENT:
        yield 0, body
        return
    starts, ends = word_bounds(np.frombuffer(body, np.uint8))
    first = 0
    while first + length <= len(starts):
        last = int(np.searchsorted(ends, starts[first] + W.SEGMENT))
        last = min(max(last, first + length), len(starts))
        yield first, body[starts[first] : ends[last - 1]]
        first = last - length + 1


def _runs(spec: W.Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        values = W.symbol_values(256, 2)
        powers = W.Powers(3 * W.SEGMENT)
        for batch in batches:
            ids, tags, wide = (batch.column(i).to_numpy() for i in (0, 1, 3))
            rows: list[list[np.ndarray]] = []
            owners, shifts, bodies, size = [], [], [], 0

            def flush() -> None:
                nonlocal owners, shifts, bodies, size, powers
                if not bodies:
                    return
                if size + len(bodies) > 3 * W.SEGMENT - 2:  # windows of very long words
                    powers = W.Powers(size + len(bodies) + 2)
                octets = np.frombuffer(b" ".join(bodies), np.uint8)
                starts, ends = word_bounds(octets)
                hashes = powers.between(powers.prefixes(values[octets], 0), starts, ends, 0)
                begins = np.cumsum([0, *[len(b) + 1 for b in bodies]])
                bounds = np.searchsorted(starts, begins)
                of, start, count, offset, key, context = W.anchored_runs(
                    W.mixed(hashes), bounds, spec, powers, ends - starts
                )
                owner, shift = np.array(owners)[of], np.array(shifts, np.int64)[of]
                place = W.pack_place(start + shift, tags[owner], count, offset, 0)
                rows.append([ids[owner], wide[owner], place, key, context])
                owners, shifts, bodies, size = [], [], [], 0

            for row, body in enumerate(batch.column(2).to_pylist()):
                if len(body) < 2 * spec.length - 1:
                    continue
                for shift, part in _parts(body, spec.length):
                    if size + len(part) > W.SEGMENT:
                        flush()
                    owners.append(row)
                    shifts.append(shift)
                    bodies.append(part)
                    size += len(part)
            flush()
            if rows:
                yield W.local_rows(*[np.concatenate(c) for c in zip(*rows)], spec.earlier)

    return run


def _contexts(spec: W.Windows):
    def fetch(texts: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
            for batch in batches:
                made = []
                ids, wides, bodies = (batch.column(i).to_pylist() for i in range(3))
                asked = batch.column(3)
                for i, (doc, wide, body) in enumerate(zip(ids, wides, bodies)):
                    words = body.split()
                    for request in asked[i].as_py():
                        place = request["place"]
                        start = W.place_start(place)
                        end = start + W.place_count(place) - 1 + spec.length
                        text = b" ".join(words[start:end])
                        made.append((request["key"], doc, wide, place, text))
                    if len(made) > 20_000:
                        yield [list(c) for c in zip(*made)]
                        made = []
                if made:
                    yield [list(c) for c in zip(*made)]

        return map_arrow(texts.select("id", "wide", "body", "requests"), _CONTEXTS, run)

    return fetch


def _resolve(spec: W.Windows):
    def resolve(contexts: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
            out = []
            for group in groups_by_key(batches):
                marks = repeated_windows(
                    [(doc, text.split(), W.place_count(place)) for _, doc, _, place, text in group],
                    spec.length,
                )
                for (_, doc, wide, place, _), mask in zip(group, marks):
                    for a, b in runs_of(mask):
                        start = W.place_start(place) + a
                        out.append((doc, wide, int(W.pack_place(start, W.place_tag(place), b - a, 0, 0))))
                if len(out) > 10_000:
                    yield [list(c) for c in zip(*out)]
                    out = []
            if out:
                yield [list(c) for c in zip(*out)]

        return map_arrow(contexts.select("key", "id", "wide", "place", "symbols"), _SPANS, run)

    return resolve


def _single(spec: W.Windows):
    def single(contexts: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
            for batch in batches:
                ids, wides, places, hashes = [], [], [], []
                for doc, wide, place, text in zip(*[c.to_pylist() for c in batch.columns]):
                    words = text.split()
                    start, tag = W.place_start(place), W.place_tag(place)
                    for at in range(W.place_count(place)):
                        window = b" ".join(words[at : at + spec.length])
                        hashes.append(hashlib.blake2b(window, digest_size=16).digest())
                        ids.append(doc)
                        wides.append(wide)
                        places.append(int(W.pack_place(start + at, tag, 1, 0, 0)))
                if ids:
                    pairs = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
                    yield W.local_rows(
                        np.array(ids),
                        np.array(wides),
                        np.array(places),
                        pairs[:, 0],
                        pairs[:, 1],
                        spec.earlier,
                    )

        return map_arrow(contexts.select("id", "wide", "place", "symbols"), W.ROWS, run)

    return single


def earlier_passages(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP
) -> DataFrame:
    """(id, tag, wide, body, places): windows of words that a document with a smaller id has too."""
    spec = W.Windows(length=length, gram=gram, earlier=True, limit=group)
    return W.window_spans(
        docs, spec, _runs(spec), _contexts(spec), _resolve(spec), _single(spec)
    )


def without_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): ``kept`` has the words left, joined by spaces."""
    found = earlier_passages(docs, length, gram, group)
    schema = StructType(
        [
            StructField("doc_id", LongType()),
            StructField("n_words", LongType()),
            StructField("n_removed", LongType()),
            StructField("kept", StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            out = []
            bodies, places = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for body, spans in zip(bodies, places):
                words = kept = body.split()
                if spans:
                    gone = W.covered_mask(spans, len(words), length).tolist()
                    kept = [w for w, g in zip(words, gone) if not g]
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
            yield [batch.column(0), *([list(c) for c in zip(*out)] if out else [[], [], []])]

    rows = found.select(W.without_null(found.id).alias("doc_id"), "body", "places")
    return map_arrow(rows, schema, run)
