"""Repeated fixed-length windows of symbol sequences, found through anchored contexts.

A window is ``length`` consecutive symbols (bytes or words) of one document. Its anchor is the
place in it of the ``gram`` symbols with the least hash, the leftmost of equals: equal windows
have their anchors at equal offsets. Consecutive windows share an anchor as long as it stays the
least, so a document is a sequence of runs of windows, each with one anchor and a context, the
symbols that its windows cover. One row per run stands for all its windows:

1. Runs become rows (id, place, key, context): hashes of the anchored gram and of the context.
   Runs with equal contexts are judged where they meet first, in the batch that reads them, and
   only the undecided ones go on, so a passage found in a third of all documents leaves a few
   rows per batch.
2. The rows are range-partitioned and sorted by (key, context, id), which deals a frequent key
   out over several partitions. Rows of one context are decided as they stream by. A key with
   several contexts may hide partial matches: their rows become requests.
3. Requests fetch the contexts themselves. Keys of up to ``limit`` contexts are resolved as one
   group by the caller's method; larger groups are split by window: each window becomes a row of
   its own as in 1, and is decided as in 2. Keys that meet the edge of a partition are counted
   over all partitions first.

Decisions are spans of window starts, which the caller joins to the documents.

Key and context are 64-bit polynomial hashes of different bases and symbol values: two contexts
are taken as equal if both agree. Documents are told apart by their ids where no two rows share one,
which is looked up first. Otherwise every row of 1 to 3 also carries ``wide``, a 64-bit hash of the
whole text, beside 13 bits of another one in its place, so any number of rows may share an id or
have none; rows alike in all of these are copies of one document and share their spans. A null id
counts as below all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, LongType, StructField, StructType

from dockpulse.llm.common import map_arrow, text_key, written

#: Symbols handled at once; longer documents are read in overlapping parts.
SEGMENT = 1 << 18
NULL_ID = -(1 << 63)

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

SPAN, SMALL, LARGE = 0, 1, 2

ROWS = StructType([StructField(n, LongType()) for n in ("id", "wide", "place", "key", "context")])
DECIDED = StructType(
    [
        StructField("kind", ByteType()),
        *[StructField(n, LongType()) for n in ("id", "wide", "place", "key")],
    ]
)


@dataclass(frozen=True)
class Windows:
    """What repeats: windows of ``length`` symbols with anchors of ``gram`` symbols.

    ``earlier`` asks for the same window in a document with a smaller id, otherwise anywhere else.
    """

    length: int
    gram: int
    earlier: bool
    limit: int


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of unsigned numbers spread over the whole word, one to one."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def symbol_values(count: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, count + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


class Powers:
    """Powers of the bases and of their inverses modulo 2**64."""

    def __init__(self, count: int):
        self.up, self.down = [], []
        for base in _BASES:
            inverse = pow(base, -1, 1 << 64)
            for powers, factor in ((self.up, base), (self.down, inverse)):
                steps = np.full(count, factor, _U)
                steps[0] = 1
                powers.append(np.cumprod(steps))

    def prefixes(self, values: np.ndarray, which: int) -> np.ndarray:
        out = np.zeros(len(values) + 1, _U)
        np.cumsum(values * self.up[which][: len(values)], out=out[1:])
        return out

    def between(self, prefixes: np.ndarray, start, end, which: int) -> np.ndarray:
        """Hashes of symbols [start, end), whatever their place."""
        return (prefixes[end] - prefixes[start]) * self.down[which][start]


def pack_place(start, tag, count, offset, done) -> np.ndarray:
    """First window start, text tag, number of windows, anchor less start, decided."""
    return (
        (np.asarray(start, np.int64) << 32)
        | (np.asarray(done, np.int64) << 31)
        | (np.asarray(tag, np.int64) << 18)
        | (np.asarray(count, np.int64) << 9)
        | np.asarray(offset, np.int64)
    )


def place_start(place):
    return place >> 32


def place_tag(place):
    return (place >> 18) & 0x1FFF


def place_count(place):
    return (place >> 9) & 0x1FF


def place_offset(place):
    return place & 0x1FF


def anchored_runs(
    values: np.ndarray,
    bounds: np.ndarray,
    spec: Windows,
    powers: Powers,
    sizes: np.ndarray | None = None,
) -> tuple[np.ndarray, ...]:
    """(sequence, start, count, offset, key, context) of the runs of several sequences.

    ``values`` are their symbols one after the other, ``bounds`` where each begins and the end.
    With ``sizes`` of the symbols the largest grams are anchors first, as they are the rarest.
    """
    n, span = len(values), spec.length - spec.gram + 1
    none = np.empty(0, np.int64)
    if n < spec.length:
        return none, none, none, none, none.view(_U), none.view(_U)
    first = powers.prefixes(values, 0)
    at = np.arange(n - spec.gram + 1)
    grams = mixed(powers.between(first, at, at + spec.gram, 0))
    low = _U((1 << 20) - 1)
    rank = grams
    if sizes is not None:
        total = np.concatenate([[0], np.cumsum(sizes)])
        size = np.minimum(total[at + spec.gram] - total[at], 63).astype(_U)
        rank = ((_U(63) - size) << _U(58)) | (grams >> _U(6))
    rank = (rank & ~low) | at.astype(_U)
    width = 1
    while width * 2 <= span:
        rank = np.minimum(rank[:-width], rank[width:])
        width *= 2
    if span > width:
        rank = np.minimum(rank[: len(rank) - (span - width)], rank[span - width :])
    anchors = (rank & low).astype(np.int64)
    lengths = np.diff(bounds)
    left = np.repeat(bounds[1:], lengths)[: len(anchors)] - np.arange(len(anchors))
    whole = left >= spec.length
    opens = whole.copy()
    opens[1:] &= ~whole[:-1] | (anchors[1:] != anchors[:-1])
    starts = np.flatnonzero(opens)
    if not len(starts):
        return none, none, none, none, none.view(_U), none.view(_U)
    closes = whole.copy()
    closes[:-1] &= ~whole[1:] | opens[1:]
    ends = np.flatnonzero(closes) + 1
    anchor = anchors[starts]
    second = powers.prefixes(mixed(values), 1)
    offset, count = anchor - starts, ends - starts
    shape = (offset.astype(_U) << _U(32)) | count.astype(_U)
    context = mixed(powers.between(second, starts, ends - 1 + spec.length, 1) ^ mixed(shape))
    sequence = np.searchsorted(bounds, starts, side="right") - 1
    return sequence, starts - bounds[sequence], count, offset, grams[anchor], context


def row_order(key: np.ndarray, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, context, key))


def decide(
    key: np.ndarray, context: np.ndarray, ids: np.ndarray, earlier: bool
) -> tuple[np.ndarray, np.ndarray]:
    """For sorted rows: which ones repeat, and which ones open a context."""
    opens = np.ones(len(key), bool)
    opens[1:] = (key[1:] != key[:-1]) | (context[1:] != context[:-1])
    starts = np.flatnonzero(opens)
    of = np.cumsum(opens) - 1
    if earlier:
        repeats = ids > ids[starts][of]
    else:
        repeats = np.diff(np.append(starts, len(key)))[of] > 1
    return repeats, opens


def local_rows(
    ids: np.ndarray,
    wide: np.ndarray,
    place: np.ndarray,
    key: np.ndarray,
    context: np.ndarray,
    earlier: bool,
) -> list[np.ndarray]:
    """Rows of a batch, sorted; those decided here are marked and dealt out by themselves."""
    by = row_order(key, context, ids)
    ids, wide, place, key, context = (c[by] for c in (ids, wide, place, key, context))
    repeats, opens = decide(key, context, ids, earlier)
    # Without an order of ids the first of equals goes on, to decide the others' partners.
    done = repeats if earlier else repeats & ~opens
    place = np.where(done, place | (1 << 31), place)
    alone = mixed(place.view(_U) ^ mixed(ids.view(_U)))
    key = np.where(done, alone, key)
    twice = repeats & opens & (not earlier)
    if twice.any():  # it is itself decided: one more row says so
        own = mixed(place[twice].view(_U) ^ mixed(ids[twice].view(_U)))
        ids = np.concatenate([ids, ids[twice]])
        wide = np.concatenate([wide, wide[twice]])
        key = np.concatenate([key, own])
        context = np.concatenate([context, context[twice]])
        place = np.concatenate([place, place[twice] | (1 << 31)])
    return [ids, wide, place, key.view(np.int64), context.view(np.int64)]


def documents(docs: DataFrame) -> DataFrame:
    """(id, tag, wide, body): what all later steps need of a document."""
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    shared = docs.groupBy(doc_id.alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    wide = F.lit(0).cast("long") if shared.isEmpty() else F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")))
    return docs.select(
        doc_id.alias("id"),
        text_key("text").bitwiseAND(F.lit(0x1FFF)).alias("tag"),
        wide.alias("wide"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"),
    )


def decided(rows: DataFrame, spec: Windows, partial: bool) -> DataFrame:
    """Spans and, if ``partial`` matches count, requests, from the rows of runs."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "key", "context").sortWithinPartitions(
        "key", "context", "id"
    )
    hold = 1 << 18

    def judge(ids, wide, place, key, context, edge) -> list:
        """Rows of whole contexts; ``edge`` marks the keys whose other contexts may be elsewhere."""
        repeats, opens = decide(key, context, ids, spec.earlier)
        out = [(SPAN, repeats)]
        if partial:
            new_key = np.ones(len(key), bool)
            new_key[1:] = key[1:] != key[:-1]
            of = np.cumsum(new_key) - 1
            contexts = np.bincount(of, opens)[of]
            wanted = ~repeats if spec.earlier else opens
            rows_of = np.bincount(of, wanted)[of]
            large = edge | (rows_of > spec.limit)
            out.append((LARGE, wanted & large))
            out.append((SMALL, wanted & ~large & (contexts > 1)))
        chosen = [np.flatnonzero(m) for _, m in out]
        kinds = np.concatenate([np.full(len(c), k, np.int8) for (k, _), c in zip(out, chosen)])
        at = np.concatenate(chosen)
        return [kinds, ids[at], wide[at], place[at], key[at]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        waiting, edge_keys = None, set()
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(5)]
            done = (columns[2] >> 31) & 1 == 1
            if done.any():
                ids, wide, place, key, _ = (c[done] for c in columns)
                yield [np.zeros(len(ids), np.int8), ids, wide, place, key]
                columns = [c[~done] for c in columns]
            if not len(columns[0]):
                continue
            if waiting is None:
                edge_keys.add(int(columns[3][0]))
                waiting = columns
            else:
                waiting = [np.concatenate(pair) for pair in zip(waiting, columns)]
            *_, key, context = waiting
            last = len(key) - int(np.argmax(key[::-1] != key[-1])) if key[0] != key[-1] else 0
            if len(key) - last > hold:  # a key too frequent to hold: its contexts one by one
                edge_keys.add(int(key[-1]))
                tail = context[last:]
                same = tail != tail[-1]
                last += len(tail) - int(np.argmax(same[::-1])) if same.any() else 0
            if last:
                head = [c[:last] for c in waiting]
                yield judge(*head, np.isin(head[3], list(edge_keys)))
                waiting = [c[last:] for c in waiting]
        if waiting is not None and len(waiting[0]):
            edge_keys.add(int(waiting[3][-1]))
            yield judge(*waiting, np.isin(waiting[3], list(edge_keys)))

    return map_arrow(dealt, DECIDED, run)


def requested(out: DataFrame, limit: int) -> DataFrame:
    """Requests of each document, with the keys at partition edges counted as wholes."""
    tag = F.shiftright("place", 18).bitwiseAND(F.lit(0x1FFF))
    sizes = out.where(F.col("kind") == LARGE).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("n") > limit, F.lit(LARGE)).otherwise(F.lit(SMALL)).cast("byte")
    return (
        out.where(F.col("kind") > SPAN)
        .join(sizes, "key", "left")
        .where("n is null or n > 1")
        .select(
            "id",
            tag.alias("tag"),
            "wide",
            F.struct(kind.alias("kind"), "place", "key").alias("request"),
        )
        .groupBy("id", "tag", "wide")
        .agg(F.collect_list("request").alias("requests"))
    )


def spans_of(decisions: DataFrame) -> DataFrame:
    """(id, tag, wide, places) for the documents that any span was found in."""
    tag = F.shiftright("place", 18).bitwiseAND(F.lit(0x1FFF))
    plain = F.col("place").bitwiseAND(F.lit(~(1 << 31)))
    return (
        decisions.select("id", tag.alias("tag"), "wide", plain.alias("place"))
        .groupBy("id", "tag", "wide")
        .agg(F.collect_list("place").alias("places"))
    )


def window_spans(
    docs: DataFrame,
    spec: Windows,
    runs: Callable[[Iterator[pa.RecordBatch]], Iterator[list]],
    contexts: Callable[[DataFrame], DataFrame],
    resolve: Callable[[DataFrame], DataFrame],
    single: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``docs`` as (id, tag, wide, body) joined with the places of their repeated windows.

    ``runs`` turns batches of (id, tag, body, wide) into columns of ROWS; ``contexts`` turns
    documents with requests into (key, id, wide, place, symbols); ``resolve`` decides groups by key
    into (id, wide, place); ``single`` makes rows of single windows of contexts.
    """
    texts = documents(docs)
    rows = map_arrow(texts.select("id", "tag", "body", "wide"), ROWS, runs)
    out = written(decided(rows, spec, partial=True), "windows")
    asked = requested(out, spec.limit)
    together = texts.join(asked, ["id", "tag", "wide"])

    def fetched(kind: int) -> DataFrame:
        wanted = F.filter("requests", lambda request: request["kind"] == kind)
        return contexts(together.withColumn("requests", wanted).where(F.size("requests") > 0))

    small, large = fetched(SMALL), fetched(LARGE)
    decisions = (
        out.where(F.col("kind") == SPAN)
        .select("id", "wide", "place")
        .unionAll(resolve(small.repartition("key").sortWithinPartitions("key", "id", "place")))
        .unionAll(decided(single(large), spec, partial=False).select("id", "wide", "place"))
    )
    return texts.join(spans_of(decisions), ["id", "tag", "wide"], "left")


def covered_mask(places: list[int], size: int, length: int) -> np.ndarray:
    """Symbols of a document of ``size`` symbols that repeated windows cover."""
    marks = np.zeros(size + 1, np.int64)
    if places:
        packed = np.array(places, np.int64)
        starts = place_start(packed)
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + place_count(packed) - 1 + length, -1)
    return np.cumsum(marks[:-1]) > 0


def without_null(column: Column) -> Column:
    return F.when(column != NULL_ID, column)
