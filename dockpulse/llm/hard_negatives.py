"""Hard negatives from labelled vectors, by an inverted multi-index.

The two halves of a vector have a codebook each, fitted on a bounded sample; the codes of both
halves form its cell. Vectors are dealt out by a hash into shards of about ``SHARD`` rows, and every
anchor visits every shard. In a shard a code bounds the half-score of its members from above by
the score of its centroid plus the anchor's norm times the code's radius there. A heap runs over
pairs of codes in the order of the summed bounds (the multi-sequence way) and scores the members of
one cell after the other. A window of scores is certified once it is full of scores that no
unvisited cell can reach, or once no unvisited cell can reach its lower end; a search ends with its
last window.

One search per anchor finds its nearest rows of the same label, a second one the best rows of
other labels in the window that each of those positives sets. Searches yield the best rows of a
shard, rankings per anchor merge them, so no group ever holds more than a few rows per shard.

Defined results: rows without vec_id, label or vector, or with a missing or non-finite component,
take no part; shorter vectors count as ended by zeros; rows that share a vec_id are rows of their
own, and only the anchor's own row is kept from being its positive; equal scores rank by vec_id.
An anchor without positives gives no rows; an empty table gives none. Scores are exact as long as
they fit 63 bits. Further columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from dockpulse.llm.common import map_arrow, written

POSITIVES = 5
NEGATIVES = 10
#: Rows of a shard, about; codes of a half; rows that the codebooks are fitted on at most.
SHARD = 8192
CODES = 8
SAMPLE = 8192
#: Rows that are scored, cell by cell, before the windows take them.
TOGETHER = 512
_ROUNDS = 8

_SHARDED = StructType(
    [
        StructField("shard", IntegerType()),
        StructField("is_query", BooleanType()),
        StructField("ref", LongType()),
        StructField("vec_id", LongType()),
        StructField("label", LongType()),
        StructField("vec", BinaryType()),
        StructField("positives", ArrayType(LongType())),
    ]
)
_FOUND = StructType(
    [StructField(n, LongType()) for n in ("anchor", "window", "ref", "vec_id", "score")]
)


def integer_vectors(
    rows: DataFrame, vector: str = "embedding", scale: int = 256
) -> DataFrame:
    """(ref, vec_id, label, vec): rows that take part, components as 64-bit integers."""
    schema = StructType(
        [
            StructField("vec_id", LongType()),
            StructField("label", LongType()),
            StructField("vec", BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            vectors = [
                np.floor(scale * np.array(v, np.float64)).astype(np.int64).tobytes()
                for v in batch.column(2).to_pylist()
            ]
            yield [batch.column(0), batch.column(1), vectors]

    values = F.col(vector).cast("array<double>")
    whole = ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        values.alias("v"),
        whole.alias("whole"),
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND whole")
    vectors = map_arrow(sound.select("vec_id", "label", "v"), schema, run)
    return vectors.withColumn("ref", F.monotonically_increasing_id())


def matrix(vectors: list[bytes], dims: int) -> np.ndarray:
    """Rows of integers; shorter ones end in zeros."""
    if all(len(v) == 8 * dims for v in vectors):
        return np.frombuffer(b"".join(vectors), np.int64).reshape(len(vectors), dims)
    out = np.zeros((len(vectors), dims), np.int64)
    for row, v in zip(out, vectors):
        row[: len(v) // 8] = np.frombuffer(v, np.int64)
    return out


def codebook(points: np.ndarray, codes: int) -> np.ndarray:
    """Centroids by a few rounds of k-means from evenly spaced points of the sample."""
    points = np.unique(points, axis=0)
    centres = points[np.linspace(0, len(points) - 1, min(codes, len(points))).astype(int)]
    for _ in range(_ROUNDS):
        of = nearest(points, centres)
        centres = np.array(
            [points[of == i].mean(axis=0) if (of == i).any() else c for i, c in enumerate(centres)]
        )
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * (points @ centres.T), axis=1)


class MultiIndex:
    """The rows of a shard in cells of two half-codes, with what bounds their scores."""

    def __init__(self, refs, ids, labels, vectors: np.ndarray, books: tuple[np.ndarray, ...]):
        half = books[0].shape[1]
        points = vectors.astype(np.float64)
        self.half, self.books = half, books
        codes = [nearest(points[:, :half], books[0]), nearest(points[:, half:], books[1])]
        self.radii = []
        for code, book, part in zip(codes, books, (points[:, :half], points[:, half:])):
            away = np.sqrt(((part - book[code]) ** 2).sum(axis=1))
            radius = np.full(len(book), -1.0)  # a code without members bounds nothing
            np.maximum.at(radius, code, away)
            self.radii.append(radius)
        by = np.lexsort((ids, codes[1], codes[0]))
        self.refs, self.ids, self.labels, self.vectors = refs[by], ids[by], labels[by], vectors[by]
        cell = codes[0][by] * len(books[1]) + codes[1][by]
        edges = np.flatnonzero(np.diff(cell, prepend=-1))
        ends = np.append(edges[1:], len(cell))
        self.cells = {int(cell[a]): (int(a), int(b)) for a, b in zip(edges, ends)}
        largest = float(np.abs(vectors).max(initial=0))
        self.exact = points[by] if largest * vectors.shape[1] < 2.0**26 else None

    def scores(self, begin: int, end: int, query: np.ndarray) -> np.ndarray:
        """Inner products, in floats if the query comes as such."""
        if self.exact is not None and query.dtype == np.float64:
            return (self.exact[begin:end] @ query).astype(np.int64)
        return self.vectors[begin:end] @ query

    def visit(self, query: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(bound, begin, end) of the cells, largest bound first; none holds a higher score."""
        q = query.astype(np.float64)
        halves = []
        for part, book, radius in zip((q[: self.half], q[self.half :]), self.books, self.radii):
            bound = book @ part + np.sqrt(part @ part) * radius
            # Rounding is far below one, and far below this margin for large numbers.
            bound += 1 + 1e-9 * np.abs(bound)
            order = np.argsort(-np.where(radius < 0, -np.inf, bound), kind="stable")
            halves.append((bound, order[: int((radius >= 0).sum())]))
        (left, left_order), (right, right_order) = halves
        if not len(left_order) or not len(right_order):
            return
        width = len(self.books[1])
        heap, seen = [(-(left[left_order[0]] + right[right_order[0]]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            span = self.cells.get(int(left_order[i]) * width + int(right_order[j]))
            if span:
                yield int(np.ceil(-bound)), *span
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < len(left_order) and b < len(right_order) and (a, b) not in seen:
                    seen.add((a, b))
                    heapq.heappush(heap, (-(left[left_order[a]] + right[right_order[b]]), a, b))


class ScoreWindow:
    """The best rows with scores from ``low`` to ``high``, by score and then id."""

    def __init__(self, low: int | None, high: int | None, keep: int):
        self.low, self.high, self.keep = low, high, keep
        self.scores = np.empty(0, np.int64)
        self.rows = np.empty(0, np.int64)

    def certified(self, bound: int) -> bool:
        """Whether no row with a score up to ``bound`` could still come in."""
        if self.low is not None and (bound < self.low or self.low > self.high):
            return True
        return len(self.scores) == self.keep and bound < self.scores[-1]

    def offer(self, scores: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        least = self.scores[-1] if len(self.scores) == self.keep else self.low
        if self.low is None:
            mine = np.arange(len(scores)) if least is None else np.flatnonzero(scores >= least)
        else:
            mine = np.flatnonzero((scores >= least) & (scores <= self.high))
        if len(mine) > 4 * self.keep:  # ties with the last place stay until ids decide
            reach = np.partition(scores[mine], -self.keep)[-self.keep]
            mine = mine[scores[mine] >= reach]
        if len(mine):
            scores = np.concatenate([self.scores, scores[mine]])
            rows = np.concatenate([self.rows, rows[mine]])
            by = np.lexsort((ids[rows], -scores))[: self.keep]
            self.scores, self.rows = scores[by], rows[by]


def search(index: MultiIndex, query: np.ndarray, admits: np.ndarray, windows: list[ScoreWindow]) -> None:
    """Fill the windows with admitted rows of the index; stops when all are certified.

    Rows are offered some ``TOGETHER`` at a time, before the next cell's bound is held against
    the windows.
    """
    waiting, size = [], 0

    def offer() -> None:
        rows = np.concatenate([np.arange(a, b) for a, b, _ in waiting])
        scores = np.concatenate([s for *_, s in waiting])
        mine = admits[rows]
        rows, scores = rows[mine], scores[mine]
        for w in windows:
            w.offer(scores, rows, index.ids)

    wide = index.exact is None or float(np.abs(query).max(initial=0)) >= 2.0**26
    exact = query if wide else query.astype(np.float64)  # products below 2**52 are whole in floats
    for bound, begin, end in index.visit(query):
        if size >= TOGETHER:
            offer()
            waiting, size = [], 0
            if all(w.certified(bound) for w in windows):
                return
        waiting.append((begin, end, index.scores(begin, end, exact)))
        size += end - begin
    if waiting:
        offer()


def _windows_of(positives: list[int] | None, positive_count: int, negative_count: int) -> list[ScoreWindow]:
    """One open window for positives; for each positive score the window of its negatives."""
    if positives is None:
        return [ScoreWindow(None, None, positive_count)]
    # 30 p <= 100 n <= 90 p in integers
    return [ScoreWindow(-(-30 * p // 100), 90 * p // 100, negative_count) for p in positives]


def _searched(
    rows: DataFrame,
    queries: DataFrame,
    books: tuple[np.ndarray, ...],
    shards: int,
    keep: tuple[int, int],
) -> DataFrame:
    """(anchor, window, ref, vec_id, score): the best of each shard for each window.

    ``queries`` have ``positives``, scores that set windows among other labels, or null for one
    open window among the same label.
    """
    dims = sum(b.shape[1] for b in books)
    shard = F.pmod(F.xxhash64("ref"), F.lit(shards)).cast("int")
    columns = ["shard", "is_query", "ref", "vec_id", "label", "vec", "positives"]
    indexed = rows.select(
        shard.alias("shard"),
        F.lit(False).alias("is_query"),
        "ref",
        "vec_id",
        "label",
        "vec",
        F.lit(None).cast("array<bigint>").alias("positives"),
    )
    asked = queries.withColumn("is_query", F.lit(True)).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    both = indexed.unionByName(asked.select(*columns))
    dealt = both.repartition(shards, "shard").sortWithinPartitions("shard", "is_query", "ref")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        waiting: list[list] = []
        index, of = None, -1
        for batch in batches:
            shards_of, is_query = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            change = np.flatnonzero((np.diff(shards_of) != 0) | (np.diff(is_query.astype(np.int8)) != 0))
            cuts = [0, *(change + 1).tolist(), batch.num_rows]
            found: list[tuple] = []
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                part = batch.slice(begin, end - begin)
                refs, ids, labels = (part.column(i).to_numpy() for i in (2, 3, 4))
                if int(shards_of[begin]) != of:
                    waiting, index, of = [], None, int(shards_of[begin])
                if not is_query[begin]:
                    waiting.append([refs, ids, labels, matrix(part.column(5).to_pylist(), dims)])
                    continue
                if waiting:
                    index = MultiIndex(*[np.concatenate(c) for c in zip(*waiting)], books)
                    waiting = []
                if index is None:  # a shard without rows
                    continue
                vectors = matrix(part.column(5).to_pylist(), dims)
                for ref, label, query, positives in zip(
                    refs.tolist(), labels.tolist(), vectors, part.column(6).to_pylist()
                ):
                    same = index.labels == label
                    admits = same & (index.refs != ref) if positives is None else ~same
                    windows = _windows_of(positives, *keep)
                    search(index, query, admits, windows)
                    for number, w in enumerate(windows):
                        rows_of = zip(index.refs[w.rows].tolist(), index.ids[w.rows].tolist(), w.scores.tolist())
                        found += [(ref, number, *row) for row in rows_of]
            if found:
                yield [list(c) for c in zip(*found)]

    return map_arrow(dealt.select(*columns), _FOUND, run)


def _ranked(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id", "ref")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Callable[[Column], Column],
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    vector: str = "embedding",
    codes: int = CODES,
    shard_rows: int = SHARD,
    sample: int = SAMPLE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor.

    ``rows`` have vec_id, label and the vector; ``is_anchor`` tells anchors by their vec_id.
    """
    held = written(integer_vectors(rows, vector), "vectors")
    count, longest = held.agg(F.count(F.lit(1)), F.max(F.octet_length("vec"))).first()
    dims = max(2, (longest or 0) // 8)
    if count:
        chosen = held.orderBy(F.xxhash64("ref"), "ref").select("vec").limit(sample).collect()
        points = matrix([bytes(r.vec) for r in chosen], dims).astype(np.float64)
    else:
        points = np.zeros((1, dims))
    books = (codebook(points[:, : dims // 2], codes), codebook(points[:, dims // 2 :], codes))
    shards = max(1, -(-count // shard_rows))
    keep = (positives, negatives)
    anchors = held.where(is_anchor(F.col("vec_id")))
    open_ = anchors.withColumn("positives", F.lit(None).cast("array<bigint>"))
    nearest_rows = written(_ranked(_searched(held, open_, books, shards, keep), positives), "positives")
    asked = anchors.join(
        nearest_rows.groupBy(F.col("anchor").alias("ref")).agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x.score
            ).alias("positives")
        ),
        "ref",
    )
    chosen = _ranked(_searched(held, asked, books, shards, keep), negatives)
    named = nearest_rows.select(
        "anchor",
        (F.col("rank") - 1).cast("long").alias("window"),
        F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    return (
        chosen.join(named, ["anchor", "window"])
        .join(anchors.select(F.col("ref").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
        .select(
            "anchor_id",
            "positive_id",
            "rank",
            F.col("vec_id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
