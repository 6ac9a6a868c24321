"""Exact Jaccard self-join of word-shingle sets by signature trees.

A document's set holds the 64-bit hashes of its distinct shingles; equal sets are one from the
start. Two sets link when ``100 * common >= percent * united``, so either one has at most a fifth
(at 80 percent) of its hashes outside the other. From there:

1. *Lonely sets go.* The lower half of each set's hashes is counted over all sets. Of two linked
   sets the one whose part ends lower has all common hashes of its part in the other's; as their
   sizes are alike, neither can have more than a fifth of its hashes, and one, unshared in its part.
   Sets that have more go. Counting travels in packed columns, a hash repeated within a batch as one
   entry, so a passage in a third of all documents adds a few entries per batch. Truncated hashes
   can only make a hash look shared and keep a set in.
2. *Groups.* Linked sets share one of the lowest ``fifth + 1`` hashes of both. The sets left meet by
   these hashes: first only by the lowest shared one of each set, then, for hashes whose sets are
   not yet of one component, by all of them, once for each different group of sets. The first time
   the hashes of the sets meet, afterwards their signatures only: what these leave open makes blocks
   of sets, whose hashes meet once more.
3. *Signature trees.* Sets of a group, sorted by size and content, are leaves of a tree whose nodes
   hold the OR of the bitmaps, the range of sizes, and the largest number of hashes that share a
   bit. Two trees are walked together: a pair of nodes is left when its sizes are too far apart, or
   when the bits they have in common plus the hashes hidden by shared bits could not make the
   overlap that the smallest sizes below them need, or when all their sets are linked already.
   Pairs of sets that remain are compared hash by hash.

Groups above ``CHUNK_HASHES`` hashes are dealt out as pairs of chunks to as many tasks. Only links
that join two components are kept, so that a group of copies yields few rows.

Defined results: a null text or one without words has the empty set and links with nothing;
fewer words than a shingle are one shingle; repeated rows are copies of each other; rows that share
a doc_id may be in different components; a null doc_id belongs to the component of its set without
ever naming it; an empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from dockpulse.llm.common import map_arrow, octets_of, utf8, written
from dockpulse.llm.simhash import components
from dockpulse.llm.windows import Powers, mixed, symbol_values

SHINGLE = 5
PERCENT = 80
#: Hashes of a chunk of a group, about; sets of a leaf and children of a node above.
CHUNK_HASHES = 1 << 19
LEAF = 64
FANOUT = 8
#: Hashes that a counting task holds, about.
PART_HASHES = 1 << 21
MIN_PARTS = 64

_U = np.uint64
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Bytes of text that are hashed at once, about.
_SEGMENT = 1 << 21


def _long(*names: str) -> StructType:
    return StructType([StructField(n, LongType()) for n in names])


def shingle_sets(bodies: list[bytes], shingle: int, powers: Powers) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    octets = _FOLD[np.frombuffer(b" ".join(bodies), np.uint8)]
    blank = np.concatenate([[True], _BLANK[octets], [True]])
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])
    ends = np.flatnonzero(~blank[:-1] & blank[1:])
    prefixes = powers.prefixes(symbol_values(256, 3)[octets], 0)
    words = mixed(powers.between(prefixes, starts, ends, 0) ^ mixed((ends - starts).astype(_U)))
    begins = np.cumsum([0, *[len(b) + 1 for b in bodies]])
    bounds = np.searchsorted(starts, begins)
    base = _U(0x9E3779B97F4A7C15)

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        total = np.zeros(len(parts[0]), _U)
        for part in parts:
            total = total * base + part
        return mixed(total ^ _U(len(parts))).view(np.int64)

    whole = len(words) - shingle + 1
    runs = joined([words[i : i + whole] for i in range(shingle)]) if whole > 0 else None
    for a, b in zip(bounds, bounds[1:]):
        n = b - a
        if n >= shingle:
            yield np.unique(runs[a : b - shingle + 1])
        elif n:
            yield joined([words[i : i + 1] for i in range(a, b)])
        else:
            yield np.empty(0, np.int64)


def sets_of(bodies: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """``shingle_sets`` of any number of texts in groups of bounded size."""
    group, size, powers = [], 0, Powers(_SEGMENT + 2)
    for body in bodies:
        if group and size + len(body) + 1 > _SEGMENT:
            yield from shingle_sets(group, shingle, powers)
            group, size = [], 0
        if len(body) + 1 > _SEGMENT:  # a very long text by itself
            yield from shingle_sets([body], shingle, Powers(len(body) + 2))
            continue
        group.append(body)
        size += len(body) + 1
    if group:
        yield from shingle_sets(group, shingle, powers)


def set_id(hashes: np.ndarray) -> int:
    """64 bits that stand for a set; zero only for the empty one."""
    if not len(hashes):
        return 0
    digest = hashlib.blake2b(hashes.tobytes(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True) or 1


def outside(n, percent: int):
    """Hashes that a set of ``n`` may have outside of a set it is linked with."""
    return n - -(-percent * n // 100)


def links_with(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common) > 0


def counted(n: int, percent: int) -> int:
    """Hashes of the lower half, never fewer than those that groups go by."""
    return max(-(-n // 2), outside(n, percent) + 1)


# -- reading ---------------------------------------------------------------------------------


def read_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, k1, k2, n, set): size and id of each document's set; k1 and k2 are the key of its
    text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            found = list(sets_of(batch.column(3).to_pylist(), shingle))
            yield [*batch.columns[:3], [len(h) for h in found], [set_id(h) for h in found]]

    schema = _long("doc_id", "k1", "k2", "n", "set")
    return map_arrow(keyed_texts(docs).select("doc_id", "k1", "k2", "body"), schema, run)


def keyed_texts(docs: DataFrame) -> DataFrame:
    body = utf8("text")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(body).alias("k1"),
        F.xxhash64(F.lit(7), body).alias("k2"),
        body.alias("body"),
    )


# -- lonely sets -----------------------------------------------------------------------------


def _six_bytes(data: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = data.reshape(-1, 6)
    return wide.view(np.int64).ravel()


def shared_counts(docs: DataFrame, shingle: int, percent: int, parts: int) -> DataFrame:
    """(set48, shared): hashes of each set's lower part that another set has there too.

    Sets go by the lower six bytes of their ids: sets that these do not tell apart add up, which
    can only keep them in.
    """
    packed = StructType(
        [
            StructField("part", IntegerType()),
            StructField("hashes", BinaryType()),
            StructField("sets", BinaryType()),
        ]
    )
    many = (1 << 48) - 1  # stands for several sets of a batch

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            lows: dict[int, np.ndarray] = {}
            for found in sets_of(batch.column(0).to_pylist(), shingle):
                if len(found):
                    lows[set_id(found) & many] = found[: counted(len(found), percent)] & many
            if not lows:
                continue
            hashes = np.concatenate(list(lows.values()))
            owners = np.repeat(np.array(list(lows)), [len(x) for x in lows.values()])
            by = np.argsort(hashes, kind="stable")
            hashes, owners = hashes[by], owners[by]
            opens = np.ones(len(hashes), bool)
            opens[1:] = hashes[1:] != hashes[:-1]
            starts = np.flatnonzero(opens)
            repeated = np.diff(np.append(starts, len(hashes))) > 1
            # one entry a hash; repeated ones are known to be shared and only say so to others
            inside = repeated[np.cumsum(opens) - 1]
            known, times = np.unique(owners[inside], return_counts=True)
            owner = np.where(repeated, many, owners[starts])
            hashes = hashes[starts]
            part = mixed(hashes.view(_U)) % _U(parts)
            by = np.argsort(part, kind="stable")
            part, hashes, owner = part[by], hashes[by], owner[by]
            cuts = np.flatnonzero(np.diff(part, prepend=part[:1] + _U(1)))
            rows = [
                (int(part[a]), _packed(hashes[a:b]), _packed(owner[a:b]))
                for a, b in zip(cuts, [*cuts[1:], len(part)])
            ]
            if len(known):
                rows.append((-1, _packed(known), times.astype("<i8").tobytes()))
            yield [list(c) for c in zip(*rows)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        """Parts come sorted; one part at a time is held."""
        of, hashes, owners = None, [], []

        def close() -> list[np.ndarray]:
            h, o = np.concatenate(hashes), np.concatenate(owners)
            hashes.clear()
            owners.clear()
            by = np.lexsort((o, h))
            h, o = h[by], o[by]
            # copies of a set in several batches bring an entry each; it counts once, and sets of
            # several batches share it even if this one is alone in its own
            other = np.ones(len(h), bool)
            other[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
            h, o = h[other], o[other]
            alone = np.ones(len(h), bool)
            alone[1:] &= h[1:] != h[:-1]
            alone[:-1] &= h[1:] != h[:-1]
            names, times = np.unique(o[~alone & (o != many)], return_counts=True)
            return [names, times]

        for batch in batches:
            for part, h, o in zip(*[c.to_pylist() for c in batch.columns]):
                if part == -1:
                    yield [_six_bytes(np.frombuffer(h, np.uint8)), np.frombuffer(o, "<i8")]
                    continue
                if part != of and hashes:
                    yield close()
                of = part
                hashes.append(_six_bytes(np.frombuffer(h, np.uint8)))
                owners.append(_six_bytes(np.frombuffer(o, np.uint8)))
        if hashes:
            yield close()

    rows = map_arrow(docs.select(utf8("text")), packed, deal)
    # what is known within a batch belongs to no part and need not gather anywhere
    key = F.when(F.col("part") >= 0, F.col("part")).otherwise(
        F.pmod(F.xxhash64("hashes"), F.lit(parts)).cast("int")
    )
    dealt = rows.withColumn("to", key).repartition(parts, "to").sortWithinPartitions("part")
    counts = map_arrow(dealt.select("part", "hashes", "sets"), _long("set48", "shared"), count)
    return counts.groupBy("set48").agg(F.sum("shared").alias("shared"))


def _packed(values: np.ndarray) -> bytes:
    return values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


# -- signature trees -------------------------------------------------------------------------


def width_of(n: int) -> int:
    """Bits of a set's signature: a power of two above twice its hashes, within limits."""
    return min(max(128, 1 << (2 * n - 1).bit_length()), 1 << 14)


def signature(hashes: np.ndarray, width: int) -> np.ndarray:
    """A bit for each hash."""
    bits = np.zeros(width // 64, _U)
    place = hashes.view(_U) & _U(width - 1)
    np.bitwise_or.at(bits, (place >> _U(6)).astype(np.int64), _U(1) << (place & _U(63)))
    return bits


@dataclass
class Member:
    """A set as the trees see it; ``mark`` names its component, ``hashes`` may be left out."""

    name: int
    mark: int
    size: int
    bits: np.ndarray
    hashes: np.ndarray | None = None


@dataclass
class Node:
    bits: np.ndarray
    low: int
    high: int
    hidden: int
    words: int
    begin: int
    end: int
    children: list["Node"]


class SignatureTree:
    """Sets in the order of size and signature, and the nodes above them.

    A signature narrower than ``width`` is repeated: each of its bits then stands for several, so
    that a hash common to two sets still has a common bit. ``words`` are the lengths before that:
    two signatures have their common bits as often as the longer of them was repeated.
    """

    def __init__(self, members: list[Member], width: int):
        self.members = sorted(members, key=lambda m: (m.size, m.bits.tobytes(), m.name))
        self.sizes = np.array([m.size for m in self.members])
        self.marks = np.array([m.mark for m in self.members])
        self.words = np.array([len(m.bits) for m in self.members])
        self.bits = np.array([np.tile(m.bits, width // 64 // len(m.bits)) for m in self.members])
        self.hidden = np.array(
            [m.size - int(np.bitwise_count(m.bits).sum()) for m in self.members]
        )
        count = len(self.members)
        level = [self._leaf(i, min(i + LEAF, count)) for i in range(0, count, LEAF)]
        while len(level) > 1:
            level = [self._above(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)]
        self.root = level[0]

    def _leaf(self, begin: int, end: int) -> Node:
        return Node(
            np.bitwise_or.reduce(self.bits[begin:end]),
            int(self.sizes[begin]),
            int(self.sizes[end - 1]),
            int(self.hidden[begin:end].max()),
            int(self.words[begin:end].max()),
            begin,
            end,
            [],
        )

    @staticmethod
    def _above(nodes: list[Node]) -> Node:
        return Node(
            np.bitwise_or.reduce([n.bits for n in nodes]),
            nodes[0].low,
            nodes[-1].high,
            max(n.hidden for n in nodes),
            max(n.words for n in nodes),
            nodes[0].begin,
            nodes[-1].end,
            nodes,
        )


def apart(a: Node, b: Node, percent: int) -> bool:
    """Whether no set below one node can link with one below the other."""
    if 100 * a.high < percent * b.low or 100 * b.high < percent * a.low:
        return True
    bits = int(np.bitwise_count(a.bits & b.bits).sum()) * max(a.words, b.words) // len(a.bits)
    common = bits + min(a.hidden, b.hidden)
    most = min(a.high, b.high, common)
    # common >= percent / 100 * (|a| + |b| - common)
    return (100 + percent) * most < percent * (a.low + b.low)


class Forest:
    """Which sets of a task are linked, directly or in chains."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)

    def of_one(self, left: np.ndarray, right: np.ndarray) -> bool:
        first = self.root(int(left[0]))
        return self.root(int(right[0])) == first and all(
            self.root(int(x)) == first for part in (left, right) for x in part
        )


def walk(
    left: SignatureTree, right: SignatureTree, forest: Forest, percent: int
) -> Iterator[tuple[Member, Member]]:
    """Pairs of sets of different components that may link; ``left`` may be ``right``.

    Whoever takes a pair may join its components in ``forest`` before asking for the next one.
    """
    same = left is right
    open_ = [(left.root, right.root)]
    while open_:
        a, b = open_.pop()
        if same and a is not b and a.begin >= b.end:
            continue  # met the other way round
        if apart(a, b, percent) or forest.of_one(left.marks[a.begin : a.end], right.marks[b.begin : b.end]):
            continue
        if a.children or b.children:
            open_ += [(x, y) for x in a.children or [a] for y in b.children or [b]]
            continue
        for i in range(a.begin, a.end):
            begin = max(b.begin, i + 1) if same else b.begin
            if begin >= b.end:
                continue
            n, others = int(left.sizes[i]), right.sizes[begin : b.end]
            common = np.bitwise_count(left.bits[i] & right.bits[begin : b.end]).sum(axis=1).astype(np.int64)
            common = common * np.maximum(left.words[i], right.words[begin : b.end]) // left.bits.shape[1]
            common += np.minimum(left.hidden[i], right.hidden[begin : b.end])
            most = np.minimum(common, np.minimum(n, others))
            for j in (begin + np.flatnonzero((100 + percent) * most >= percent * (n + others))).tolist():
                if forest.root(int(left.marks[i])) != forest.root(int(right.marks[j])):
                    yield left.members[i], right.members[j]


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return links_with(common, len(x), len(y), percent)


def group_pairs(
    groups: DataFrame, sets: DataFrame, percent: int, chunk_hashes: int, compare: bool
) -> DataFrame:
    """(src, dst): marks of the sets that meet in ``groups`` (token, set, n, mark), each with the
    least mark that it is linked with there.

    Sets of one mark count as linked. With ``compare`` the sets themselves meet, otherwise only
    signatures do and the marks are those of sets that may link.
    """
    sizes = groups.groupBy("token").agg(
        F.count(F.lit(1)).alias("members"), F.sum("n").alias("hashes")
    )
    chunks = F.greatest(F.lit(1), F.ceil(F.col("hashes") / chunk_hashes)).cast("int")
    placed = (
        groups.join(sizes.where("members > 1"), "token")
        .withColumn("chunks", chunks)
        .withColumn("mine", F.pmod(F.xxhash64("set", F.lit("chunk")), F.col("chunks")).cast("int"))
        # Every pair of chunks meets once: a set goes to the pairs that hold its chunk.
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            "token",
            F.least("mine", "other").alias("low"),
            F.greatest("mine", "other").alias("high"),
            (F.col("mine") > F.col("other")).alias("second"),
            "set",
            "mark",
            "n",
        )
    )
    body = "hashes" if compare else "bits"
    keys = ["token", "low", "high"]
    dealt = (
        placed.join(sets.select("set", body), "set")
        .repartition(*keys)
        .sortWithinPartitions(*keys)
        .select(*keys, "second", "set", "mark", "n", body)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for rows in by_key(batches, 3):
            sides: tuple[list[Member], list[Member]] = ([], [])
            for *_, second, name, mark, size, data in rows:
                if compare:
                    hashes = np.frombuffer(data, np.int64)
                    member = Member(name, mark, size, signature(hashes, width_of(size)), hashes)
                else:
                    member = Member(name, mark, size, np.frombuffer(data, _U))
                sides[second].append(member)
            width = 64 * max(len(m.bits) for side in sides for m in side)
            trees = [SignatureTree(side, width) for side in sides if side]
            if len(trees) < 2 and rows[0][1] != rows[0][2]:
                continue
            forest = Forest()
            for x, y in walk(trees[0], trees[-1], forest, percent):
                if not compare or linked(x.hashes, y.hashes, percent):
                    forest.join(x.mark, y.mark)
            found = [(x, root) for x in list(forest.parent) if (root := forest.root(x)) != x]
            if found:
                yield [list(c) for c in zip(*found)]

    return map_arrow(dealt, _long("src", "dst"), run)


def by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows that share their first columns, from sorted batches."""
    group: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if group and group[-1][:keys] != row[:keys]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


# -- the join --------------------------------------------------------------------------------


def _full_sets(docs: DataFrame, chosen: DataFrame, shingle: int) -> DataFrame:
    """(set, n, hashes, bits) of the sets in ``chosen``, each from one text."""
    schema = StructType(
        [
            StructField("set", LongType()),
            StructField("n", LongType()),
            StructField("hashes", BinaryType()),
            StructField("bits", BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            found = list(sets_of(batch.column(0).to_pylist(), shingle))
            yield [
                [set_id(h) for h in found],
                [len(h) for h in found],
                [h.tobytes() for h in found],
                [signature(h, width_of(len(h))).tobytes() for h in found],
            ]

    texts = keyed_texts(docs).join(chosen.select("k1", "k2"), ["k1", "k2"], "left_semi")
    # copies of one text, however many, fall together where they are read
    single = texts.groupBy("k1", "k2").agg(F.any_value("body").alias("body"))
    return map_arrow(single.select("body"), schema, run)


def _group_hashes(sets: DataFrame, percent: int) -> DataFrame:
    """(token, set, n): the lowest hashes of each set, one of which linked sets share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            names, sizes = (batch.column(i).to_numpy() for i in (0, 1))
            octets, offsets = octets_of(batch.column(2))
            counts = outside(sizes, percent) + 1
            lows = [
                octets[offsets[i] : offsets[i] + 8 * counts[i]].view(np.int64)
                if offsets[i] % 8 == 0
                else np.frombuffer(octets[offsets[i] : offsets[i] + 8 * counts[i]].tobytes(), np.int64)
                for i in range(len(names))
            ]
            if lows:
                yield [np.concatenate(lows), np.repeat(names, counts), np.repeat(sizes, counts)]

    return map_arrow(sets.select("set", "n", "hashes"), _long("token", "set", "n"), run)


def roots_of(groups: DataFrame, sets: DataFrame, percent: int, chunk_hashes: int) -> DataFrame:
    """(node, root) of the marks linked in ``groups``, no two of which have a mark in common.

    A group that is one chunk is settled where it meets; only marks of larger ones are linked in
    several places, which takes a search for components.
    """
    edges = written(group_pairs(groups, sets, percent, chunk_hashes, compare=True), "links")
    largest = groups.groupBy("token").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > chunk_hashes:
        return written(components(edges), "components")
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))


def similar_sets(
    docs: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    chunk_hashes: int = CHUNK_HASHES,
    part_hashes: int = PART_HASHES,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    read = written(read_sets(docs, shingle), "shingles")
    total = read.agg(F.sum("n")).first()[0] or 0
    parts = max(MIN_PARTS, total // (2 * part_hashes) + 1)
    shared = shared_counts(docs, shingle, percent, parts)
    distinct = (
        read.where("n > 0")
        .groupBy("set", "n")
        .agg(F.min(F.struct("k1", "k2")).alias("text"), F.min("doc_id").alias("least"))
    )
    low_six = F.col("set").bitwiseAND(F.lit((1 << 48) - 1))
    allowed = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    unshared = F.greatest(F.ceil(F.col("n") / 2), allowed) - F.coalesce("shared", F.lit(0))
    left = (
        distinct.withColumn("set48", low_six)
        .join(shared, "set48", "left")
        .where(unshared <= allowed)
        .select("set", "text.k1", "text.k2")
    )
    sets = written(_full_sets(docs, written(left, "chosen"), shingle), "sets")
    lows = _group_hashes(sets, percent)
    lows = lows.repartition("token")  # moved once, for the count and for the join
    repeated = lows.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    meeting = written(lows.join(repeated, "token"), "groups")
    first = meeting.groupBy("set", "n").agg(F.min("token").alias("token"))
    alone = first.withColumn("mark", F.col("set"))
    so_far = roots_of(alone, sets, percent, chunk_hashes)
    marked = meeting.join(so_far, meeting.set == so_far.node, "left").select(
        "token", "set", "n", F.coalesce("root", "set").alias("mark")
    )
    # Hashes that the very same sets have, those of one passage, make one group.
    one, two = (F.xxhash64("set", F.lit(x)).cast("decimal(38,0)") for x in (1, 2))
    mixed_tokens = (
        marked.groupBy("token")
        .agg(
            F.min("mark").alias("a"),
            F.max("mark").alias("b"),
            F.sum(one).alias("one"),
            F.sum(two).alias("two"),
        )
        .where("a != b")
        .groupBy("one", "two")
        .agg(F.min("token").alias("token"))
        .select("token")
    )
    maybe = written(
        group_pairs(marked.join(mixed_tokens, "token"), sets, percent, chunk_hashes, compare=False),
        "candidates",
    )
    # All sets that may link are of one block; its sets meet once, however many hashes they share.
    blocks = written(components(maybe), "blocks")
    members = (
        first.select("set", "n")
        .join(so_far, first.set == so_far.node, "left")
        .select("set", "n", F.coalesce("root", "set").alias("mark"))
    )
    gathered = members.join(blocks, members.mark == blocks.node).select(
        F.col("root").alias("token"), "set", "n", "mark"
    )
    roots = roots_of(gathered, sets, percent, chunk_hashes)
    first_roots = so_far.select(F.col("node").alias("set"), F.col("root").alias("mark"))
    named = (
        distinct.join(first_roots, "set", "left")
        .withColumn("mark", F.coalesce("mark", "set"))
        .join(roots, F.col("mark") == roots.node, "left")
        .select("set", "least", F.coalesce("root", "mark").alias("root"))
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "root").select("set", "component_id")
    return read.join(classes, "set", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
