"""Removal of byte strings that occur more than once, by hash-compared suffix sorting.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else is removed.
``windows`` finds the candidates: suffixes that begin at content-chosen anchors and share their
first bytes. What remains for each group of such suffixes is sorted here:

* prefix polynomial hashes of each suffix and binary search give the longest common extension of
  two suffixes in a logarithmic number of comparisons;
* a merge sort by that comparison puts the suffixes in order, once to the right of the anchors
  and once, reversed, to the left;
* the extensions of neighbours are verified byte by byte, so a hash collision cannot pass.

Neighbours' extensions give those of all pairs (the least one between them), so the windows that
repeat are found without going through the pairs.

Defined results: a null text counts as empty; texts shorter than the length keep everything;
repeated rows are copies of one another, whatever their doc_id; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

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
from dockpulse.llm.common import map_arrow, octets_of

LENGTH = 400
GRAM = 100
#: Suffixes that are sorted as one group at most; larger groups are split by window.
GROUP = 32768
#: Prefix hashes are kept at every so many bytes.
STRIDE = 8

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


class Suffix:
    """A byte string with the polynomial hashes of its prefixes of whole strides."""

    __slots__ = ("data", "hashes")

    def __init__(self, data: bytes, values: np.ndarray, powers: W.Powers):
        self.data = data
        self.hashes = powers.prefixes(values[np.frombuffer(data, np.uint8)], 0)[::STRIDE].copy()


def common_extension(a: Suffix, b: Suffix) -> int:
    """Length of the longest common prefix, by binary search on the prefix hashes."""
    x, y = a.hashes, b.hashes
    low, high = 0, min(len(x), len(y)) - 1
    while low < high:
        middle = (low + high + 1) // 2
        if x[middle] == y[middle]:
            low = middle
        else:
            high = middle - 1
    at, end = low * STRIDE, min(len(a.data), len(b.data))
    while at < end and a.data[at] == b.data[at]:
        at += 1
    return at


def verified_extension(a: Suffix, b: Suffix) -> int:
    """The common prefix confirmed on the bytes; a collision shortens it to the true one."""
    found = common_extension(a, b)
    if a.data[:found] != b.data[:found]:
        found = next(i for i in range(found) if a.data[i] != b.data[i])
    return found


def goes_first(a: Suffix, b: Suffix) -> bool:
    at = common_extension(a, b)
    return a.data[at : at + 1] <= b.data[at : at + 1]


def merge_sorted(items: list[int], first: Callable[[int, int], bool]) -> list[int]:
    """Bottom-up merge sort; ``first`` tells whether an item may stand before another."""
    runs = [[i] for i in items]
    while len(runs) > 1:
        merged = []
        for left, right in zip(runs[::2], runs[1::2]):
            out, i, j = [], 0, 0
            while i < len(left) and j < len(right):
                if first(left[i], right[j]):
                    out.append(left[i])
                    i += 1
                else:
                    out.append(right[j])
                    j += 1
            merged.append(out + left[i:] + right[j:])
        runs = merged + ([runs[-1]] if len(runs) % 2 else [])
    return runs[0] if runs else []


def suffix_order(suffixes: list[Suffix]) -> tuple[list[int], np.ndarray]:
    """The sorted order, and the common extension of each suffix with the one before it."""
    order = merge_sorted(
        list(range(len(suffixes))), lambda i, j: goes_first(suffixes[i], suffixes[j])
    )
    shared = [verified_extension(suffixes[i], suffixes[j]) for i, j in zip(order, order[1:])]
    return order, np.array([-1, *shared])


def repeated_windows(
    contexts: list[tuple[bytes, int, int]], length: int, values: np.ndarray, powers: W.Powers
) -> list[np.ndarray]:
    """For each (context, anchor offset, windows): which of its windows another one has too.

    A window that begins ``i`` bytes before the anchor repeats if another suffix shares
    ``length - i`` bytes from the anchor on and ``i`` bytes before it.
    """
    m = len(contexts)
    right = [Suffix(data[offset:], values, powers) for data, offset, _ in contexts]
    left = [Suffix(data[:offset][::-1], values, powers) for data, offset, _ in contexts]
    right_order, right_shared = suffix_order(right)
    left_order, left_shared = suffix_order(left)
    offsets = np.array([offset for _, offset, _ in contexts])
    counts = np.array([count for _, _, count in contexts])
    marks = [np.zeros(count, bool) for count in counts]
    least, most = int((offsets - counts).min()) + 1, int(offsets.max())
    # The classes of equal strings change only at these numbers of bytes before the anchor.
    steps = np.concatenate([length - right_shared[1:], left_shared[1:] + 1, [least]])
    steps = np.unique(steps[(steps >= least) & (steps <= most)])
    for begin, end in zip(steps, [*steps[1:], most + 1]):
        right_class, left_class = np.empty(m, np.int64), np.empty(m, np.int64)
        right_class[right_order] = np.cumsum(right_shared < length - begin)
        left_class[left_order] = np.cumsum(left_shared < begin)
        _, of, sizes = np.unique(
            right_class * (m + 1) + left_class, return_inverse=True, return_counts=True
        )
        for x in np.flatnonzero(sizes[of] > 1).tolist():
            # Window ``w`` of a context begins ``offset - w`` bytes before the anchor.
            first = max(offsets[x] - end + 1, 0)
            last = min(offsets[x] - begin, counts[x] - 1)
            if first <= last:
                marks[x][first : last + 1] = True
    return marks


def runs_of(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2)]


def _spec(length: int, gram: int, group: int) -> W.Windows:
    return W.Windows(length=length, gram=gram, earlier=False, limit=group)


def _segments(lengths: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int]]]:
    """(text, from, to) in groups of about a segment; long texts in parts that share
    ``length - 1`` bytes, so that each window is in one of them."""
    group, size = [], 0
    for text in np.flatnonzero(lengths >= length).tolist():
        whole = int(lengths[text])
        step = whole if whole <= 2 * W.SEGMENT else W.SEGMENT
        for start in range(0, whole - length + 1, step):
            end = min(start + step + length - 1, whole) if step < whole else whole
            if group and size + end - start > W.SEGMENT:
                yield group
                group, size = [], 0
            group.append((text, start, end))
            size += end - start
    if group:
        yield group


def _runs(spec: W.Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        values = W.symbol_values(256, 1)
        powers = W.Powers(2 * W.SEGMENT + 2 * spec.length + 2)
        for batch in batches:
            ids, tags, wide = (batch.column(i).to_numpy() for i in (0, 1, 3))
            octets, offsets = octets_of(batch.column(2))
            rows: list[list[np.ndarray]] = []
            for group in _segments(np.diff(offsets), spec.length):
                owners, froms, tos = (np.array(c, np.int64) for c in zip(*group))
                text = np.concatenate(
                    [octets[offsets[o] + a : offsets[o] + b] for o, a, b in group]
                )
                bounds = np.concatenate([[0], np.cumsum(tos - froms)])
                of, start, count, offset, key, context = W.anchored_runs(
                    values[text], bounds, spec, powers
                )
                owner = owners[of]
                place = W.pack_place(start + froms[of], tags[owner], count, offset, 0)
                rows.append([ids[owner], wide[owner], place, key, context])
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
                    for request in asked[i].as_py():
                        place = request["place"]
                        start = W.place_start(place)
                        end = start + W.place_count(place) - 1 + spec.length
                        made.append((request["key"], doc, wide, place, body[start:end]))
                    if len(made) > 10_000:
                        yield [list(c) for c in zip(*made)]
                        made = []
                if made:
                    yield [list(c) for c in zip(*made)]

        return map_arrow(texts.select("id", "wide", "body", "requests"), _CONTEXTS, run)

    return fetch


def groups_by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Lists of the rows that share the first column, from sorted batches."""
    group: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if group and group[-1][0] != row[0]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def _resolve(spec: W.Windows):
    def resolve(contexts: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
            values, powers = W.symbol_values(256, 1), W.Powers(4 * spec.length)
            out = []
            for group in groups_by_key(batches):
                places = [place for _, _, _, place, _ in group]
                marks = repeated_windows(
                    [(data, W.place_offset(p), W.place_count(p)) for p, (*_, data) in zip(places, group)],
                    spec.length,
                    values,
                    powers,
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
            values, powers = W.symbol_values(256, 1), W.Powers(4 * spec.length)
            second = W.mixed(values)
            for batch in batches:
                ids, wides, places = (batch.column(i).to_numpy() for i in range(3))
                rows: list[list[np.ndarray]] = []
                for doc, wide, place, data in zip(ids, wides, places, batch.column(3).to_pylist()):
                    octets = np.frombuffer(data, np.uint8)
                    at = np.arange(W.place_count(int(place)))
                    hashes = [
                        W.mixed(powers.between(powers.prefixes(v[octets], k), at, at + spec.length, k))
                        for k, v in enumerate((values, second))
                    ]
                    start = W.place_start(int(place)) + at
                    packed = W.pack_place(start, W.place_tag(int(place)), 1, 0, 0)
                    rows.append([np.full(len(at), doc), np.full(len(at), wide), packed, *hashes])
                if rows:
                    yield W.local_rows(*[np.concatenate(c) for c in zip(*rows)], spec.earlier)

        return map_arrow(contexts.select("id", "wide", "place", "symbols"), W.ROWS, run)

    return single


def repeated_bytes(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP
) -> DataFrame:
    """(id, tag, wide, body, places) of every document, places of windows that start elsewhere too."""
    spec = _spec(length, gram, group)
    return W.window_spans(
        docs, spec, _runs(spec), _contexts(spec), _resolve(spec), _single(spec)
    )


def without_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    group: int = GROUP,
    with_bytes: bool = True,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document.

    ``kept`` has the bytes that are left; it is null unless ``with_bytes`` asks for them.
    """
    found = repeated_bytes(docs, length, gram, group)
    schema = StructType(
        [
            StructField("doc_id", LongType()),
            StructField("n_bytes", LongType()),
            StructField("n_removed", LongType()),
            StructField("n_spans", LongType()),
            StructField("kept_sha256", StringType()),
            StructField("kept", BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            out = []
            octets, offsets = octets_of(batch.column(1))
            for i, spans in enumerate(batch.column(2)):
                kept = octets[offsets[i] : offsets[i + 1]]
                size, edges = len(kept), 0
                if spans.is_valid:
                    gone = W.covered_mask(spans.as_py(), size, length)
                    kept = kept[~gone]
                    edges = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                digest = hashlib.sha256(kept).hexdigest()
                text = kept.tobytes() if with_bytes else None
                out.append((size, size - len(kept), edges, digest, text))
            columns = [list(c) for c in zip(*out)] if out else [[] for _ in range(5)]
            yield [batch.column(0), *columns]

    rows = found.select(W.without_null(found.id).alias("doc_id"), "body", "places")
    return map_arrow(rows, schema, run)
