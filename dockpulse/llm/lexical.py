"""Ranked lexical search, one term at a time with a limited set of accumulators.

Queries come in blocks of bounded size; for each block two passes read all documents. The first
counts documents, terms and the documents of each query term. The second scores: each task gathers
up to ``SHARD`` documents, inverts the query terms they hold, and goes through the terms of each
query from the rarest on. A document gets an accumulator when a term first reaches it, until the
remaining terms together could not lift an untouched document to the score that is now the
``top``-th best; from there on only the accumulators that exist, and can still reach that score,
are updated, exactly. The best of a task's earlier documents count when its score is sought. Tasks
yield their best documents for each query, and a ranking per query merges these few rows.

Scores are integers: w * ((10**9 * tf) div (1000 * tf + 12 * m)) summed over the query's terms with
repeats, w = floor(1000 * ln((2N + 2) / (2 df + 1))), m = 75 + (25 * n * N) div L.

Defined results: a null or empty text has no terms, is not counted in N and never ranked; equal
scores rank by doc_id, a missing one last; repeated documents rank as often as they occur; every
query row is answered by itself, also those that share an item_id or have none; a query without
terms, or whose terms no document has, gives no rows; an empty table of either kind gives none.
Further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from dockpulse.llm.common import map_arrow, utf8, written
from dockpulse.llm.decontamination import words_of

TOP = 20
#: Documents that a task inverts at once.
SHARD = 16384
#: Bytes of query texts that are searched for in one pair of passes.
BLOCK_BYTES = 1 << 24

_COUNTS = StructType(
    [
        StructField("term", BinaryType()),
        StructField("docs", LongType()),
        StructField("words", LongType()),
    ]
)
_FOUND = StructType([StructField(n, LongType()) for n in ("query", "doc_id", "score")])


@dataclass(frozen=True)
class Block:
    """Queries with the statistics of their terms: term numbers from the rarest on, and repeats."""

    queries: list[tuple[int, np.ndarray, np.ndarray]]
    numbers: dict[bytes, int]
    weights: np.ndarray
    docs: int
    words: int


def count_terms(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes | None, tuple[int, int]]:
    """Documents of each term; under None the documents with any term and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        held, total, words = Counter(), 0, 0
        for batch in batches:
            for body in batch.column(0).to_pylist():
                terms = words_of(body)
                if terms:
                    total += 1
                    words += len(terms)
                    held.update(vocabulary.intersection(terms))
        yield [[None, *held], [total, *held.values()], [words, *[0] * len(held)]]

    counts = map_arrow(docs.select(utf8("text")), _COUNTS, run)
    sums = counts.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))
    # one row per term of the block's vocabulary at most
    return {
        None if row.term is None else bytes(row.term): (row.docs, row.words) for row in sums.collect()
    }


def prepare(docs: DataFrame, queries: list[tuple[int, bytes]]) -> Block | None:
    terms = {number: Counter(words_of(body)) for number, body in queries}
    vocabulary = frozenset(t for c in terms.values() for t in c)
    if not vocabulary:
        return None
    counts = count_terms(docs, vocabulary)
    total, words = counts.pop(None, (0, 0))
    known = sorted(counts, key=lambda t: (counts[t][0], t))
    numbers = {t: i for i, t in enumerate(known)}
    weights = [math.floor(1000 * math.log((2 * total + 2) / (2 * counts[t][0] + 1))) for t in known]
    ordered = []
    for number, repeats in terms.items():
        mine = sorted(numbers[t] for t in repeats if t in numbers)
        if mine:
            times = [repeats[known[i]] for i in mine]
            ordered.append((number, np.array(mine), np.array(times, np.int64)))
    return Block(ordered, numbers, np.array(weights, np.int64), total, words)


class Shard:
    """Documents inverted by the terms of a block, with each term's part of the score."""

    def __init__(self, block: Block):
        self.block = block
        self.ids: list[int | None] = []
        self._parts: list[tuple[np.ndarray, ...]] = []

    def add(self, ids: list[int | None], bodies: list[bytes]) -> None:
        """Take documents in; those without any term have no part in the ranking."""
        number, terms, lengths, kept = self.block.numbers.get, [], [], []
        for doc_id, body in zip(ids, bodies):
            words = words_of(body)
            if words:
                terms.append(np.array([number(w, -1) for w in words], np.int64))
                lengths.append(len(words))
                kept.append(doc_id)
        if not kept:
            return
        n = np.array(lengths, np.int64)
        at = np.repeat(np.arange(len(kept)), n)
        flat = np.concatenate(terms)
        known = flat >= 0
        pairs, tf = np.unique(flat[known] * len(kept) + at[known], return_counts=True)
        term, doc = pairs // len(kept), pairs % len(kept)
        m = 75 + (25 * n * self.block.docs) // self.block.words
        part = self.block.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        self._parts.append((term, doc + len(self.ids), part))
        self.ids += kept

    def inverted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each term's postings begin and the end, their documents and parts of the score."""
        term, doc, part = (np.concatenate(c) for c in zip(*self._parts))
        by = np.argsort(term, kind="stable")
        bounds = np.searchsorted(term[by], np.arange(len(self.block.numbers) + 1))
        return bounds, doc[by], part[by]


def accumulate(
    terms: np.ndarray,
    repeats: np.ndarray,
    postings: tuple[np.ndarray, np.ndarray, np.ndarray],
    size: int,
    top: int,
    floor: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Documents that may be among the ``top`` and their whole scores.

    ``floor`` is a score that ``top`` documents are known to reach.
    """
    bounds, docs, parts = postings
    lists = []
    for term, times in zip(terms.tolist(), repeats.tolist()):
        begin, end = bounds[term], bounds[term + 1]
        if end > begin:
            values = parts[begin:end] * times
            lists.append((docs[begin:end], values, int(values.max())))
    remaining = sum(most for *_, most in lists)
    scores, open_ = np.zeros(size, np.int64), np.zeros(size, bool)
    creating, kth = True, floor
    for doc, value, most in lists:
        if creating and remaining < kth:
            creating = False
        if creating:
            scores[doc] += value
            open_[doc] = True
        else:
            mine = open_[doc]
            scores[doc[mine]] += value[mine]
        remaining -= most
        found = np.flatnonzero(open_)
        if len(found) >= top:
            kth = max(kth, int(np.partition(scores[found], -top)[-top]))
        if not creating:  # what cannot reach the kth score any more is given up
            open_[found[scores[found] + remaining < kth]] = False
    found = np.flatnonzero(open_ & (scores > 0))
    return found, scores[found]


def _best(ids: list, scores: list[int], top: int) -> tuple[list, list[int]]:
    """The ``top`` of these by score, then id, a missing id last."""
    order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i] is None, ids[i] or 0))[:top]
    return [ids[i] for i in order], [scores[i] for i in order]


def search_block(docs: DataFrame, block: Block, top: int, shard: int) -> DataFrame:
    """(query, doc_id, score): the best documents of each task for each query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        best: dict[int, tuple[list, list[int]]] = {}

        def close(part: Shard) -> None:
            postings = part.inverted()
            for query, terms, repeats in block.queries:
                ids, scores = best.get(query, ([], []))
                floor = scores[-1] if len(scores) == top else 0
                found, new = accumulate(terms, repeats, postings, len(part.ids), top, floor)
                if len(found) > top:  # ties at the end stay until ids decide
                    reach = new >= np.partition(new, -top)[-top]
                    found, new = found[reach], new[reach]
                best[query] = _best(
                    ids + [part.ids[i] for i in found.tolist()], scores + new.tolist(), top
                )

        part = Shard(block)
        for batch in batches:
            part.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if len(part.ids) >= shard:
                close(part)
                part = Shard(block)
        if part.ids:
            close(part)
        rows = [(q, i, s) for q, (ids, scores) in best.items() for i, s in zip(ids, scores)]
        if rows:
            yield [list(c) for c in zip(*rows)]

    return map_arrow(docs.select(F.col("doc_id").cast("long"), utf8("text")), _FOUND, run)


def search(
    docs: DataFrame,
    queries: DataFrame,
    top: int = TOP,
    shard: int = SHARD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of each row of ``queries``."""
    # Written once: the numbers that tell query rows apart must not change from pass to pass.
    items = written(
        queries.select(
            "item_id", F.monotonically_increasing_id().alias("query"), utf8("text").alias("body")
        ),
        "queries",
    )
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    found = []
    for number in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == number)
        rows = [(row.query, bytes(row.body)) for row in mine.select("query", "body").collect()]
        block = prepare(docs, rows)
        if block is not None:
            part = search_block(docs, block, top, shard)
            found.append(part if blocks == 1 else written(part, "ranked"))
    if not found:
        found = [docs.sparkSession.createDataFrame([], _FOUND)]
    merged = found[0]
    for part in found[1:]:
        merged = merged.unionAll(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(items.select("query", "item_id"), "query").select(
        "item_id", "rank", "doc_id", "score"
    )
