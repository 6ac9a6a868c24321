"""Near-duplicate documents by SimHash, linked through a segment-popcount embedding.

A fingerprint has 64 bits. Its embedding holds the number of set bits of each of 32 two-bit
segments. Flipping a bit moves one coordinate by one, so the Manhattan distance of two embeddings
never exceeds the Hamming distance of the fingerprints: it is a lower bound to prune by.

The range join uses grids. The coordinates form ``blocks`` runs; two fingerprints with at most
``radius`` differing bits differ in at most ``radius`` runs, so they share the cell of at least
one grid that is made of ``blocks - radius`` runs. Each distinct fingerprint is placed in one cell
per grid; within a cell the Manhattan distance over the other runs prunes, then the Hamming
distance decides. Cells are dealt with as streams of chunks of at most ``CHUNK`` fingerprints, and
every pair of chunks contributes a spanning forest of its links instead of all its pairs, so a
cell of any size needs bounded memory and yields few rows. A cell with more than one chunk is
dealt out to as many tasks as it has pairs of chunks.

Defined results: a null text counts as empty, an empty text has the fingerprint zero and links as
any other; repeated rows give one row each; rows of one doc_id share a component, and a null
doc_id belongs to the component of its fingerprint without ever naming it (a component of nulls
only has a null id). An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from dockpulse.llm.common import checkpointed, map_arrow, utf8

SHINGLE = 3
RADIUS = 2
BLOCKS = 4
#: Fingerprints of a cell that are compared with one another at once.
CHUNK = 1024

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


def fingerprint(words: list[bytes], shingle: int = SHINGLE, seed: int = 42) -> int:
    """Majority of the bits of the shingles' XXH64, as an unsigned number."""
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    hashes = np.array(
        [
            digest(joined[a : b - 1], seed)
            for a, b in zip([0, *ends[:-shingle]], ends[shingle - 1 :])
        ],
        "<u8",
    )
    octets = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.empty((8, 8), np.int64)
    for octet in range(8):
        frequency = np.bincount(octets[:, octet], minlength=256)
        counts[octet] = frequency @ _BYTE_BITS
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, axis=1, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""
    schema = StructType([StructField("doc_id", LongType()), StructField("fp", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            values = [fingerprint(text.lower().split()) for text in batch.column(1).to_pylist()]
            yield [batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))]

    return map_arrow(docs.select(F.col("doc_id").cast("long"), utf8(text_col)), schema, run)


def embedding_runs(fp: Column, blocks: int) -> list[Column]:
    """Popcounts of the two-bit segments, two bits each, cut into ``blocks`` runs of segments."""
    odd = fp.bitwiseAND(F.lit(0x5555555555555555))
    even = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(0x5555555555555555))
    counts = odd.bitwiseXOR(even).bitwiseOR(F.shiftleft(odd.bitwiseAND(even), 1))
    cuts = [64 * i // blocks // 2 * 2 for i in range(blocks + 1)]
    return [
        F.shiftrightunsigned(counts, low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        if high - low < 64
        else counts
        for low, high in zip(cuts, cuts[1:])
    ]


def grid_cells(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(grid, cell, fp): one row per fingerprint and grid."""
    runs = embedding_runs(F.col("fp"), blocks)
    grids = []
    for number, kept in enumerate(itertools.combinations(range(blocks), blocks - radius)):
        bits = sum((64 * (i + 1) // blocks // 2 * 2) - (64 * i // blocks // 2 * 2) for i in kept)
        if bits > 64:
            raise ValueError("a grid has at most 64 bits of coordinates")
        cell, shift = F.lit(0).cast("long"), 0
        for i in kept:
            cell = cell.bitwiseOR(F.shiftleft(runs[i], shift))
            shift += (64 * (i + 1) // blocks // 2 * 2) - (64 * i // blocks // 2 * 2)
        grids.append(F.struct(F.lit(number).alias("grid"), cell.alias("cell")))
    return fps.select(F.explode(F.array(*grids)).alias("g"), "fp").select("g.grid", "g.cell", "fp")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def _segment_counts(fps: np.ndarray) -> np.ndarray:
    odd = np.uint64(0x5555555555555555)
    return (fps & odd) + ((fps >> np.uint64(1)) & odd)


def chunk_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between (and for a is b, within) two chunks."""
    ca, cb = _segment_counts(a), _segment_counts(b)
    parent = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    low = np.uint64(0x5555555555555555)
    left, right = [], []
    for i in range(len(a)):
        # Counts are 0, 1 or 2 in two bits each; as 0, 1, 3 their bits differ as far as the counts.
        unary_b = cb | (cb >> np.uint64(1) & low)
        unary_a = ca[i] | (ca[i] >> np.uint64(1) & low)
        near = np.flatnonzero(_popcount(unary_a ^ unary_b) <= radius)
        near = near[_popcount(a[i] ^ b[near]) <= radius]
        for j in near.tolist():
            x, y = int(a[i]), int(b[j])
            if x != y and (p := root(x)) != (q := root(y)):
                parent[max(p, q)] = min(p, q)
                left.append(x)
                right.append(y)
    return np.array(left, np.uint64), np.array(right, np.uint64)


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(src, dst): links whose connected components are those of all pairs within ``radius``.

    ``fps`` has distinct fingerprints.
    """
    cells = grid_cells(fps, radius, blocks)
    sizes = cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit("chunk")), F.col("chunks")).cast("int")
    placed = (
        cells.join(sizes, ["grid", "cell"])
        .withColumn("chunks", chunks)
        .withColumn("mine", mine)
        # Every pair of chunks meets once: a fingerprint goes to the pairs that hold its chunk.
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            "grid",
            "cell",
            F.least("mine", "other").alias("low"),
            F.greatest("mine", "other").alias("high"),
            (F.col("mine") > F.col("other")).alias("second"),
            "fp",
        )
    )
    dealt = placed.repartition("grid", "cell", "low", "high").sortWithinPartitions(
        "grid", "cell", "low", "high"
    )
    schema = StructType([StructField("src", LongType()), StructField("dst", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for first, second, fp in sorted_groups(batches, 4):
            group = fp.view(np.uint64)
            a = group[~second]
            b = group[second] if first[2] != first[3] else a
            src, dst = chunk_links(a, b, radius)
            if len(src):
                yield [pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))]

    def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int):
        last, seconds, values = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys + 2)]
            change = np.zeros(batch.num_rows, bool)
            for c in columns[:keys]:
                change[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for start, end in zip(starts, starts[1:]):
                key = tuple(int(c[start]) for c in columns[:keys])
                if key != last and last is not None:
                    yield last, np.concatenate(seconds), np.concatenate(values)
                    seconds, values = [], []
                last = key
                seconds.append(columns[keys][start:end])
                values.append(columns[keys + 1][start:end])
        if last is not None:
            yield last, np.concatenate(seconds), np.concatenate(values)

    return map_arrow(dealt, schema, run)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges``; the root is the least node of its component.

    Alternates large-star and small-star steps, each a grouping by node, until nothing changes.
    Rows per step never exceed the edges, and a node's neighbours are never gathered: minima come
    from partial aggregates and a join.
    """
    edges = checkpointed(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .where("u != v")
        .distinct()
    )

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        # pairs: (u, v); every v (large: greater than u) and u itself get the least of u's group.
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        joined = pairs.join(least, "u").withColumn("m", F.least("u", "m"))
        if large:
            moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            ends = F.explode(F.array("v", "u")).alias("w")
            moved = joined.select(ends, "m").select(F.col("w").alias("u"), F.col("m").alias("v"))
        return moved.where("u != v").distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(
            pairs.agg(
                F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
            ).first()
        )

    before = state(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = checkpointed(star(star(both, large=True), large=False))
        if (after := state(edges)) == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(
    docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, text_col: str = "text"
) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``."""
    prints = checkpointed(fingerprints(docs, text_col))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), radius, blocks))
    grouped = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = grouped.join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, text_col: str = "text") -> DataFrame:
    """``docs`` with the document of each component that has the least doc_id, which names it.

    Rows that share this doc_id all stay.
    """
    found = near_duplicates(docs, radius, text_col=text_col)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept.doc_id), "left_semi")
