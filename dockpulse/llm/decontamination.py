"""Removal of benchmark passages from training text with a generalised suffix automaton.

The normalised items build one automaton; the words of each document stream through it. The state
tracks the longest run of words, ending at the current one, that occurs in any item. A window is
``window`` consecutive words of an item, or the whole of a shorter item; every document word in an
occurrence of a window is a hit. Items are known by state: the state whose strings include the
last ``window`` words lists the items they occur in.

The automaton is broadcast, so it is held to about ``SHARD_WORDS`` item words. A larger benchmark is
split by a hash of its rows into as many automata as that takes, longer items into pieces that share
all but one word of a window. The documents pass through one automaton after the other: each is
built, broadcast, used for a pass whose result is written, and released before the next one, so
neither driver nor workers hold more than one. Passes are narrow and nothing is shuffled.

Defined results: a null or empty text has no words, is never hit and its coverage is 0; an item
without words matches nothing; a null item_id counts as an item named by the empty string;
items that share an id count once; repeated rows are judged row by row; an empty benchmark leaves
everything clean. Columns of the documents that clash with names used here keep their values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from dockpulse.llm.common import map_arrow, utf8, written

WINDOW = 10
#: Words of all items in one automaton at most (some 100 MB of states in each Python worker).
SHARD_WORDS = 200_000

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences with the windows that they consist of."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [
            (name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])
            for name, words in items
            if words
        ]
        for _, codes in coded:
            last = 0
            for code in codes:
                last = self._extend(last, code)
        by_length = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        #: The state that holds the last ``window`` words, and the next one up with short items.
        self.windowed = [-1] * len(self.link)
        for state in by_length:
            if self.length[state] >= window:
                up = self.link[state]
                self.windowed[state] = self.windowed[up] if self.length[up] >= window else state
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, dict[int, set[str]]] = {}
        for name, codes in coded:
            for at, state, matched in self._walk(codes):
                if len(codes) < window:
                    if at == len(codes) - 1:
                        while self.length[self.link[state]] >= matched:
                            state = self.link[state]
                        self.short.setdefault(state, {}).setdefault(matched, set()).add(name)
                elif matched >= window:
                    self.items.setdefault(self.windowed[state], set()).add(name)
        self.short_up = [-1] * len(self.link)
        for state in by_length:
            self.short_up[state] = state if state in self.short else self.short_up[self.link[state]]
        self.shortest = min((min(len(c), window) for _, c in coded), default=0)

    def _extend(self, last: int, code: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(code)
        if known is not None and length[known] == length[last] + 1:
            return known
        split_only = known is not None
        if split_only:
            new = -1
        else:
            new = self._state({}, length[last] + 1)
            while last >= 0 and code not in nxt[last]:
                nxt[last][code] = new
                last = link[last]
        if last < 0:
            link[new] = 0
            return new
        target = nxt[last][code]
        if length[target] == length[last] + 1:
            link[new] = target
            return new
        clone = self._state(dict(nxt[target]), length[last] + 1)
        link[clone], link[target] = link[target], clone
        if not split_only:
            link[new] = clone
        while last >= 0 and nxt[last].get(code) == target:
            nxt[last][code] = clone
            last = link[last]
        return clone if split_only else new

    def _state(self, transitions: dict[int, int], length: int) -> int:
        self.next.append(transitions)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _walk(self, codes: list[int]) -> Iterator[tuple[int, int, int]]:
        """(position, state, matched words) after each word."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        for at, code in enumerate(codes):
            while state and code not in nxt[state]:
                state = link[state]
                matched = length[state]
            if (to := nxt[state].get(code)) is None:
                matched = 0
            else:
                state, matched = to, matched + 1
            yield at, state, matched

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal hit spans [start, end) of a document, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if not self.shortest or len(words) < self.shortest:
            return spans, found
        code = self.vocabulary.get
        codes = np.array([code(w, -1) for w in words])
        known = np.concatenate([[False], codes >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        for start, end in edges.reshape(-1, 2).tolist():
            if end - start < self.shortest:
                continue
            for at, state, matched in self._walk(codes[start:end].tolist()):
                reach = 0
                if matched >= self.window:
                    reach = self.window
                    found |= self.items[self.windowed[state]]
                up = self.short_up[state]
                while up > 0:
                    for size, names in self.short[up].items():
                        if size <= matched:
                            reach = max(reach, size)
                            found |= names
                    up = self.short_up[self.link[up]]
                if reach:
                    low, high = start + at + 1 - reach, start + at + 1
                    while spans and spans[-1][1] >= low:
                        low = min(low, spans.pop()[0])
                    spans.append((low, high))
        return spans, found


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted union of spans [start, end)."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` less the words of ``spans`` and what stands between the words of one span."""
    if not spans:
        return text
    bounds = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : bounds[start][0]])
        at = bounds[end - 1][1]
    return b"".join([*out, text[at:]])


def _shards(
    benchmark: DataFrame, window: int, shard_words: int
) -> tuple[int, Iterator[list[tuple[str, bytes]]]]:
    """How many, and items in groups of about ``shard_words`` words, one on the driver at a time."""
    schema = StructType([StructField("name", StringType()), StructField("body", BinaryType())])
    step = max(1, shard_words // 4)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            names, bodies = [], []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(body)
                for start in range(0, max(1, len(words) - window + 1), step):
                    names.append(name)
                    bodies.append(b" ".join(words[start : start + step + window - 1]))
            yield [names, bodies]

    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), utf8("text").alias("body")
    )
    pieces = map_arrow(items, schema, cut)
    # A word and its separator take two bytes at least.
    total = pieces.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    count = max(1, -(-total // (2 * shard_words)))

    def groups() -> Iterator[list[tuple[str, bytes]]]:
        for shard in range(count):
            mine = pieces.where(F.pmod(F.xxhash64("name", "body"), F.lit(count)) == shard)
            yield [(row.name, bytes(row.body)) for row in mine.collect()]

    return count, groups()


def _hit_rows(
    docs: DataFrame,
    benchmark: DataFrame,
    carried: list[str],
    columns: list[StructField],
    finish,
    window: int,
    shard_words: int,
) -> DataFrame:
    """``doc``, a struct of the ``carried`` columns, and what ``finish`` makes of each document."""
    kept = StructType([docs.schema[c] for c in carried])
    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
    passing = StructType(
        [
            StructField("doc", kept),
            StructField("body", BinaryType()),
            StructField("spans", ArrayType(span)),
            StructField("items", ArrayType(StringType())),
        ]
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("doc"), utf8("text").alias("body")
    )
    context = docs.sparkSession.sparkContext
    count, shards = _shards(benchmark, window, shard_words)
    out = StructType([StructField("doc", kept), *columns])

    def scanning(automaton, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
            scan = automaton.value.scan
            for batch in batches:
                bodies = batch.column(1).to_pylist()
                earlier = (
                    zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
                    if batch.num_columns > 2
                    else (((), ()) for _ in bodies)
                )
                made = []
                for body, (spans, items) in zip(bodies, earlier):
                    words = words_of(body)
                    new, names = scan(words)
                    if spans:
                        new = merge_spans(new + [(s["start"], s["end"]) for s in spans])
                        names = names | set(items)
                    if last:
                        made.append(finish(body, words, new, names))
                    else:
                        made.append(([{"start": a, "end": b} for a, b in new], sorted(names)))
                extra = [list(c) for c in zip(*made)] if made else [[] for _ in columns]
                yield [batch.column(0), *extra] if last else [batch.column(0), batch.column(1), *extra]

        return run

    for number, shard in enumerate(shards, 1):
        automaton = context.broadcast(Automaton([(n, words_of(b)) for n, b in shard], window))
        if number == count:
            rows = map_arrow(rows, out, scanning(automaton, True))
        else:
            rows = written(map_arrow(rows, passing, scanning(automaton, False)), "decontamination")
            automaton.destroy()
    return rows


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """``doc`` (the document's columns but its text), its words, hit words and items found."""

    def finish(body, words, spans, items):
        return len(words), sum(b - a for a, b in spans), sorted(items)

    columns = [
        StructField("n_words", LongType()),
        StructField("n_hit", LongType()),
        StructField("items", ArrayType(StringType())),
    ]
    carried = [c for c in docs.columns if c != "text"]
    return _hit_rows(docs, benchmark, carried, columns, finish, window, shard_words)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    max_coverage: float = 0.5,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``docs`` with hit spans cut out of their texts, less those covered beyond the limit.

    ``n_chars``, if there is such a column, follows the new text.
    """

    def finish(body, words, spans, items):
        hit = sum(b - a for a, b in spans)
        covered = hit > max_coverage * len(words)
        return covered, without_spans(body, spans).decode() if spans and not covered else None

    columns = [StructField("covered", BooleanType()), StructField("cut", StringType())]
    rows = _hit_rows(docs, benchmark, docs.columns, columns, finish, window, shard_words)
    rows = rows.where("not covered")
    text = F.coalesce("cut", "doc.text")
    changed = {"text": text}
    if "n_chars" in docs.columns:
        length = F.char_length("cut").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.coalesce(length, "doc.n_chars")
    return rows.select(
        *[changed.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns]
    )
