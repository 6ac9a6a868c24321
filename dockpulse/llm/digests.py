"""Document fingerprints of improbable features in chained Bloom filters.

Every ``WINDOW`` bytes of a text are a feature candidate. Its rank is the rarity of its Shannon
entropy, taken from a histogram over all windows of all documents: entropies that few windows
have come first, windows of next to no entropy come last. Of each ``NEIGHBOURS`` consecutive
windows the first of the least rank gains a point, and windows with ``POPULARITY`` points are the
features. Their hashes go into Bloom filters of ``BITS`` bits, ``FEATURES`` to a filter, then the
next filter of the chain begins. Two fingerprints compare filter by filter: the bits that a
filter shares with its best counterpart, less those that chance lets it share, over the most
that they could share, weighted by the filters' bits.

Entropies are sums of whole numbers, so equal texts have equal fingerprints wherever they are
computed.

Defined results: a null text counts as empty; empty texts have the empty fingerprint and are alike
to one another only; a text shorter than a window is one feature; a text without a popular window
has its most popular one. The next document follows in descending doc_id, then by text; null ids
come last, and the last document is followed by the first, which for a single document is itself.
Repeated rows follow one another. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from dockpulse.llm.common import map_arrow, text_key, utf8
from dockpulse.llm.windows import NULL_ID, mixed

WINDOW = 64
NEIGHBOURS = 64
POPULARITY = 16
BITS = 2048
HASHES = 5
FEATURES = 160
#: Entropy classes, and the entropy in bits below which a window is no feature if others are.
LEVELS = 1024
LEAST_ENTROPY = 1.0
#: Bytes that are ranked at once.
SEGMENT = 1 << 18

_U = np.uint64
_SCALE = 1 << 10
_COUNTS = np.arange(WINDOW + 1)
#: c * log2(c) in fixed point, and its steps.
_MASS = np.rint(_COUNTS * np.log2(np.maximum(_COUNTS, 1)) * _SCALE).astype(np.int64)
_STEP = np.diff(_MASS)
_TOP = int(_MASS[WINDOW])


@dataclass
class Fingerprint:
    filters: list[int]

    def text(self) -> str:
        return ":".join(f"{bits:0{BITS // 4}x}" for bits in self.filters)


def window_levels(octets: np.ndarray) -> np.ndarray:
    """Entropy class of the window at each place, from 0 (one byte only) to LEVELS - 1.

    The entropy of a window is known from that of the one before it and from how often the byte
    that leaves, and the byte that enters, occur in between.
    """
    n = len(octets)
    if n < WINDOW:
        return np.empty(0, np.int64)
    order = np.argsort(octets, kind="stable")
    keys = octets[order].astype(np.int64) * (n + WINDOW) + order
    at = np.arange(n)
    # Of the same byte, in order of place: the first within reach before each, the last after it.
    reach = np.searchsorted(keys, keys - (WINDOW - 1))
    last = np.cumsum(np.bincount(reach, minlength=n)) - 1
    earlier, later = np.empty(n, np.int64), np.empty(n, np.int64)
    earlier[order], later[order] = at - reach, last - at
    mass = np.empty(n - WINDOW + 1, np.int64)
    mass[0] = _MASS[np.bincount(octets[:WINDOW], minlength=1)].sum()
    mass[1:] = _STEP[earlier[WINDOW:]] - _STEP[later[: n - WINDOW]]
    mass = np.cumsum(mass)
    return (_TOP - mass) * (LEVELS - 1) // _TOP


def window_hashes(octets: np.ndarray, at: np.ndarray) -> np.ndarray:
    words = octets[at[:, None] + np.arange(WINDOW)].view("<u8")
    out = np.full(len(at), 0x9E3779B97F4A7C15, _U)
    for column in range(words.shape[1]):
        out = mixed(out ^ words[:, column])
    return out


def _filters(hashes: np.ndarray) -> list[int]:
    """Chained filters of distinct features in the order of their first place."""
    _, first = np.unique(hashes, return_index=True)
    hashes = hashes[np.sort(first)]
    out = []
    for begin in range(0, len(hashes), FEATURES):
        part = hashes[begin : begin + FEATURES]
        bits = np.zeros(BITS, np.uint8)
        for k in range(HASHES):
            bits[(part >> _U(11 * k)) & _U(BITS - 1)] = 1
        out.append(int.from_bytes(np.packbits(bits).tobytes(), "big"))
    return out


def _segments(sizes: list[int]) -> Iterator[range]:
    """Stretches of texts of about a segment together."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size > SEGMENT:
            yield range(first, i)
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield range(first, len(sizes))


def levels_of(texts: list[bytes]) -> list[np.ndarray]:
    """Entropy classes of the windows of each text."""
    out = []
    for segment in _segments([len(t) for t in texts]):
        levels = window_levels(np.frombuffer(b"".join(texts[i] for i in segment), np.uint8))
        begin = 0
        for i in segment:
            out.append(levels[begin : begin + max(len(texts[i]) - WINDOW + 1, 0)].astype(np.int16))
            begin += len(texts[i])
    return out


def fingerprints(
    texts: list[bytes], levels: list[np.ndarray], ranks: np.ndarray
) -> list[Fingerprint]:
    """Fingerprints of texts with their windows' ``levels``, by the rank of each class."""
    out = [Fingerprint([]) for _ in texts]
    for segment in _segments([len(t) for t in texts]):
        best = ranks[np.concatenate([levels[i] for i in segment])] << 32
        best |= np.arange(len(best))
        plain, width = best, 1
        while width < NEIGHBOURS:
            best = np.minimum(best[: max(len(best) - width, 0)], best[width:])
            width *= 2
        chosen = best & 0xFFFFFFFF
        begin = 0
        for i in segment:
            text, windows = texts[i], len(levels[i])
            if not windows:
                if text:
                    short = hashlib.blake2b(text, digest_size=8).digest()
                    out[i] = Fingerprint(_filters(np.frombuffer(short, "<u8")))
                continue
            slides = windows - NEIGHBOURS + 1
            if slides <= 0:
                at = np.array([int(np.argmin(plain[begin : begin + windows]))])
            else:
                points = np.bincount(chosen[begin : begin + slides] - begin)
                at = np.flatnonzero(points >= POPULARITY)
                if not len(at):
                    at = np.array([int(np.argmax(points))])
            out[i] = Fingerprint(_filters(window_hashes(np.frombuffer(text, np.uint8), at)))
            begin += windows
    return out


def _alike(a: int, b: int) -> float:
    """Shared bits of two filters beyond chance, as a share of the most they could share."""
    bits_a, bits_b = a.bit_count(), b.bit_count()
    by_chance, most = bits_a * bits_b / BITS, min(bits_a, bits_b)
    if most <= by_chance:
        return 1.0 if a == b else 0.0
    return min(max(((a & b).bit_count() - by_chance) / (most - by_chance), 0.0), 1.0)


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """From 0 to 1; the fingerprint with fewer filters looks for its own in the other."""
    if not a.filters or not b.filters:
        return 1.0 if a.filters == b.filters else 0.0
    if a.filters == b.filters:
        return 1.0
    if (len(a.filters), a.filters) > (len(b.filters), b.filters):
        a, b = b, a
    weights = [f.bit_count() for f in a.filters]
    found = [max(_alike(f, g) for g in b.filters) for f in a.filters]
    return sum(w * x for w, x in zip(weights, found)) / sum(weights)


def entropy_ranks(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy class, the rarest first, counted over all windows of ``docs``."""
    schema = StructType([StructField("level", IntegerType()), StructField("n", LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            total = np.zeros(LEVELS, np.int64)
            for levels in levels_of(batch.column(0).to_pylist()):
                total += np.bincount(levels, minlength=LEVELS)
            at = np.flatnonzero(total)
            yield [at.astype(np.int32), total[at]]

    counted = map_arrow(docs.select(utf8("text")), schema, count)
    rows = counted.groupBy("level").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(LEVELS, np.int64)
    for row in rows:
        seen[row.level] = row.n
    # Classes that no window has rank first among the rarest; weak ones after all others.
    weak = np.arange(LEVELS) < LEAST_ENTROPY / np.log2(WINDOW) * LEVELS
    order = np.lexsort((np.arange(LEVELS), seen, weak))
    ranks = np.empty(LEVELS, np.int64)
    ranks[order] = np.arange(LEVELS)
    return ranks


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, id, sort, extra, body), each bucket a stretch of documents in descending order.

    A bucket's last row, marked ``extra``, is the first document of the stretch that follows; the
    last stretch is followed by the first. So every document meets its next one in a task, and
    only one document per bucket is read twice.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"),
        text_key("text").alias("sort"),
        utf8("text").alias("body"),
    )
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / buckets for i in range(1, buckets)]
    # As many numbers as there are buckets, whatever the table holds.
    quantiles = np.array(rows.approxQuantile("id", shares, 0.25 / buckets) or [], np.float64)
    bounds = np.unique(quantiles.clip(-9e18, 9e18)).astype(np.int64)

    @F.pandas_udf(IntegerType())
    def bucket_of(ids: pd.Series) -> pd.Series:
        above = len(bounds) - np.searchsorted(bounds, ids.to_numpy(), side="right")
        return pd.Series(above.astype(np.int32))

    placed = rows.withColumn("bucket", bucket_of("id"))
    firsts = (
        placed.groupBy("bucket")
        .agg(F.max(F.struct("id", "sort")).alias("first"))
        .orderBy("bucket")
        .collect()
    )
    schema = "into int, first struct<id:long,sort:long>"
    before = [(firsts[i - 1].bucket, f.first) for i, f in enumerate(firsts)]
    leads = spark.createDataFrame(before, schema)
    extra = (
        placed.drop("bucket")
        .join(
            F.broadcast(leads),
            (F.col("id") == F.col("first.id")) & (F.col("sort") == F.col("first.sort")),
        )
        .select(F.col("into").alias("bucket"), "id", "sort", F.lit(True).alias("extra"), "body")
    )
    own = placed.select("bucket", "id", "sort", F.lit(False).alias("extra"), "body")
    return (
        own.unionAll(extra)
        .repartition("bucket")
        .sortWithinPartitions("bucket", "extra", F.desc("id"), F.desc("sort"))
    )


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the next text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how near they and the next are."""
    ranks = docs.sparkSession.sparkContext.broadcast(entropy_ranks(docs))
    schema = StructType(
        [
            StructField("doc_id", LongType()),
            StructField("n_chars", LongType()),
            StructField("edited_sha256", StringType()),
            StructField("fingerprint", StringType()),
            StructField("edited_fingerprint", StringType()),
            StructField("near_edited", DoubleType()),
            StructField("near_next", DoubleType()),
        ]
    )

    def rows_of(rows: list[tuple], levels: list[np.ndarray], prints: list) -> list[list]:
        """Of each row that its next one follows in the same bucket."""
        pairs = [
            i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][2]
        ]
        texts = {i: rows[i][3].decode() for j in pairs for i in (j, j + 1)}
        edited = [edited_text(texts[i], texts[i + 1]).encode() for i in pairs]
        # Windows within the part that stays are those of the text itself.
        same = [
            max(len(texts[i][: len(texts[i]) - len(texts[i]) // 3].encode()) - WINDOW + 1, 0)
            for i in pairs
        ]
        tails = levels_of([text[n:] for text, n in zip(edited, same)])
        known = [np.concatenate([levels[i][:n], t]) for i, n, t in zip(pairs, same, tails)]
        changed = fingerprints(edited, known, ranks.value)
        out = [
            (
                None if rows[i][1] == NULL_ID else rows[i][1],
                len(texts[i]),
                hashlib.sha256(text).hexdigest(),
                prints[i].text(),
                new.text(),
                likeness(prints[i], new),
                likeness(prints[i], prints[i + 1]),
            )
            for i, text, new in zip(pairs, edited, changed)
        ]
        return [list(c) for c in zip(*out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        waiting: list[tuple] = []
        levels: list[np.ndarray] = []
        prints: list[Fingerprint] = []
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                new = list(zip(*[c.to_pylist() for c in part.columns]))
                texts = [row[3] for row in new]
                found = levels_of(texts)
                waiting += new
                levels += found
                prints += fingerprints(texts, found, ranks.value)
                if columns := rows_of(waiting, levels, prints):
                    yield columns
                waiting, levels, prints = waiting[-1:], levels[-1:], prints[-1:]

    return map_arrow(in_order(docs).select("bucket", "id", "extra", "body"), schema, run)
