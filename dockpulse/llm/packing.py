"""Packing of tokenized documents into training windows by multiway differencing.

Documents are tokenized where they are read and dealt out by a hash of id and content, so no
key gathers in one task. Each task packs its share in units of at most ``UNIT_WINDOWS`` windows:

* whole windows are cut off the front of long documents and need no partner;
* what is left is cut into pieces of at most a few hundred tokens, and Karmarkar-Karp multiway
  differencing deals the pieces of a unit into windows: every piece starts as a partial partition
  of its own, and the two partitions with the largest imbalance are merged with opposing slots
  until one is left, whose windows are nearly equal;
* if its fullest window exceeds the capacity, the unit is packed again with one window more.

Defined results: a null text has no tokens but the end token; a null doc_id stays null; repeated
rows are packed as often as they occur; an empty table gives no rows. Windows hold at most
``capacity`` tokens and each token lies in exactly one piece.
"""

from __future__ import annotations

import heapq
import os
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from dockpulse.llm.common import map_arrow

#: Tokens of a window, of a piece at most, and windows packed together at most.
CAPACITY = 2048
PIECE = 512
UNIT_WINDOWS = 96
#: Share of a unit's windows that is filled on purpose: room for differencing to end in.
FILL = 0.99
#: Words whose ids a worker keeps, from task to task, at most; beyond it the store starts anew.
CACHED_WORDS = 800_000
#: Texts that are split and encoded at once, and words of a line handed to the tokenizer.
_TEXTS, _LINE = 2048, 256
#: Texts on which a tokenizer must agree with its word-wise use.
_PROBES = (
    "Some words, with MARKS; don't it's 12 3.5 (x)!  two\tblanks\nand \u00c9tude \u03a3\u0391\u03a3, end.",
    "a,b c. d? e!f ... x_y -- \u65e5\u672c\u8a9e \u00bd",
)

_PIECES = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("start", LongType()),
        StructField("length", LongType()),
        StructField("ids_crc32", LongType()),
        StructField("doc_tokens", LongType()),
        StructField("sequence_id", LongType()),
        StructField("offset", LongType()),
    ]
)


class WordIds:
    """Ids of texts, word by word: every different word of a batch is encoded once.

    A tokenizer that drops white space and never merges across it gives a text the ids of its
    words, and those of a word less its closing marks and these marks. Whether it does, and has a
    special token to set words apart by, is tried out on loading; texts of any other tokenizer,
    and texts that may hold a special token, are encoded as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        special = [(t.content, i) for i, t in self._tokenizer.get_added_tokens_decoder().items() if t.special]
        self._specials = sorted({text[:2] for text, _ in special})
        self._mark, self._mark_id = max(special, key=lambda s: s[1]) if special else (None, -1)
        self._clear()
        self._by_words = self._mark is not None and self._agrees()

    def _agrees(self) -> bool:
        texts = pa.array(list(_PROBES), pa.string())
        try:
            ids, bounds = self._words_of(texts)
        except ValueError:
            return False
        plain = [self._plain(t) for t in _PROBES]
        self._clear()
        return all(ids[a:b].tolist() == p for a, b, p in zip(bounds, bounds[1:], plain))

    def _clear(self) -> None:
        self._slots: dict[str, int] = {}
        self._starts = self._counts = np.empty(0, np.int64)
        self._ids = np.empty(0, np.uint32)

    def _plain(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[str]) -> None:
        lines = [self._mark.join(words[i : i + _LINE]) + self._mark for i in range(0, len(words), _LINE)]
        encoded = self._tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in encoded])
        ends = np.flatnonzero(ids == self._mark_id)
        if len(ends) != len(words):
            raise ValueError("the tokenizer does not keep marked words apart")
        starts = np.concatenate([[0], ends[:-1] + 1])
        known = len(self._slots)
        self._slots.update(zip(words, range(known, known + len(words))))
        self._starts = np.concatenate([self._starts, starts + len(self._ids)])
        self._counts = np.concatenate([self._counts, ends - starts])
        self._ids = np.concatenate([self._ids, ids])

    def _words_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after the other, and where each begins and the end."""
        folded = pc.ascii_lower(texts)
        spaced = pc.replace_substring_regex(folded, r"([a-z])([.,;:!?]+)([ \n]|$)", r"\1 \2\3")
        split = pc.ascii_split_whitespace(spaced)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self._slots) + len(words) > CACHED_WORDS:
            self._clear()
        slots = np.fromiter(map(self._slots.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = np.arange(len(self._slots), len(self._slots) + len(new))
            self._learn([words[i] for i in new.tolist()])
        of = slots[coded.indices.to_numpy()]
        counts = self._counts[of]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = self._ids[np.repeat(self._starts[of] - ends[:-1], counts) + np.arange(ends[-1])]
        offsets = split.offsets.to_numpy()
        return ids, ends[offsets - offsets[0]]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        if not self._by_words:
            return [np.array(self._plain(t), np.uint32) for t in texts.to_pylist()]
        odd = np.zeros(len(texts), bool)
        for start in self._specials:
            odd |= pc.match_substring(texts, start).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        for i in np.flatnonzero(odd).tolist():
            out[i] = np.array(self._plain(texts[i].as_py()), np.uint32)
        even = np.flatnonzero(~odd)
        if len(even):
            ids, bounds = self._words_of(texts.take(pa.array(even)))
            for i, a, b in zip(even.tolist(), bounds.tolist(), bounds[1:].tolist()):
                out[i] = ids[a:b]
        return out


def id_type(tokenizer_path: str, end_id: int) -> str:
    """The narrowest layout that holds all ids of the tokenizer."""
    from tokenizers import Tokenizer

    largest = max(Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True).values())
    return "<u2" if max(largest, end_id) < 1 << 16 else "<u4"


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, layout: str) -> DataFrame:
    """(doc_id, salt, ids as binary in ``layout``), with ``end_id`` at each end."""
    schema = StructType(
        [
            StructField("doc_id", LongType()),
            StructField("salt", IntegerType()),
            StructField("ids", BinaryType()),
        ]
    )
    end = np.array([end_id], layout).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kept = vars(sys).setdefault("_dockpulse_words", {})
        if tokenizer_path not in kept:
            kept[tokenizer_path] = WordIds(tokenizer_path)
        words = kept[tokenizer_path]
        for batch in batches:
            for part in (batch.slice(i, _TEXTS) for i in range(0, batch.num_rows, _TEXTS)):
                found = words.encode(part.column(1).cast(pa.string()))
                packed = [ids.astype(layout).tobytes() + end for ids in found]
                yield [part.column(0), [zlib.crc32(i) & 0x7FFFFFFF for i in packed], packed]

    text = F.coalesce(F.col("text"), F.lit(""))
    return map_arrow(docs.select(F.col("doc_id").cast("long"), text), schema, run)


def difference_partition(sizes: list[int], ways: int) -> list[list[int]]:
    """Karmarkar-Karp: indexes of ``sizes`` dealt into ``ways`` groups of nearly equal sums."""
    if not sizes:
        return [[] for _ in range(ways)]
    n = len(sizes)
    left, right = np.full(2 * n * 8, -1), np.full(2 * n * 8, -1)
    nodes = n
    heap, order = [], n
    for i, size in enumerate(sizes):
        sums, members = np.zeros(ways, np.int64), np.full(ways, -1)
        sums[0], members[0] = size, i
        heap.append((-size, i, sums, members))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, a_members = heapq.heappop(heap)
        _, _, b, b_members = heapq.heappop(heap)
        sums, b_members = a + b[::-1], b_members[::-1]
        members = np.where(a_members >= 0, a_members, b_members)
        both = np.flatnonzero((a_members >= 0) & (b_members >= 0))
        if len(both):
            if nodes + len(both) > len(left):
                left = np.concatenate([left, np.full(len(left), -1)])
                right = np.concatenate([right, np.full(len(right), -1)])
            new = np.arange(nodes, nodes + len(both))
            left[new], right[new] = a_members[both], b_members[both]
            members[both] = new
            nodes += len(both)
        by = np.argsort(-sums, kind="stable")
        sums, members = sums[by], members[by]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), order, sums, members))
        order += 1
    groups = []
    for root in heap[0][3].tolist():
        group, open_nodes = [], [root] if root >= 0 else []
        while open_nodes:
            node = open_nodes.pop()
            if node < n:
                group.append(node)
            else:
                open_nodes += [int(left[node]), int(right[node])]
        groups.append(sorted(group))
    return groups


def powers_of_two(total: int) -> list[int]:
    """The summands of ``total`` that are powers of two, largest first."""
    return [1 << bit for bit in reversed(range(total.bit_length())) if total >> bit & 1]


@dataclass
class Piece:
    doc: int
    start: int
    length: int


def pack_unit(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """Windows of at most ``capacity`` tokens; their count rises until no window is too full."""
    total = sum(p.length for p in pieces)
    if total <= capacity:  # one window: lengths that need no padding
        windows, rest, sizes = [], list(reversed(pieces)), powers_of_two(total)
        for size in sizes:
            window = []
            while size:
                piece = rest.pop()
                if piece.length > size:
                    rest.append(Piece(piece.doc, piece.start + size, piece.length - size))
                    piece = Piece(piece.doc, piece.start, size)
                window.append(piece)
                size -= piece.length
            windows.append(window)
        return windows
    sizes = [p.length for p in pieces]
    ways = -(-total // capacity)
    while True:
        groups = difference_partition(sizes, ways)
        if max(sum(sizes[i] for i in group) for group in groups) <= capacity:
            return [[pieces[i] for i in group] for group in groups if group]
        ways += 1


def pack_share(
    rows: Iterator[tuple[int | None, bytes]],
    capacity: int,
    piece: int,
    first_id: int,
    layout: str = "<u2",
) -> Iterator[list[tuple]]:
    """Rows of pieces, unit by unit, for a stream of documents."""
    next_id, docs, pieces, waiting = first_id, [], [], 0

    def row(p: Piece, offset: int) -> tuple:
        doc_id, ids = docs[p.doc]
        part = ids[p.start : p.start + p.length].astype("<u4").tobytes()
        return (doc_id, p.start, p.length, zlib.crc32(part), len(ids), next_id, offset)

    def close() -> list[tuple]:
        nonlocal next_id
        out = []
        for window in pack_unit(pieces, capacity):
            offset = 0
            for p in window:
                out.append(row(p, offset))
                offset += p.length
            next_id += 1
        return out

    for doc_id, raw in rows:
        ids = np.frombuffer(raw, layout)
        docs.append((doc_id, ids))
        whole = len(ids) // capacity * capacity
        out = []
        for start in range(0, whole, capacity):
            out.append(row(Piece(len(docs) - 1, start, capacity), 0))
            next_id += 1
        rest = len(ids) - whole
        parts = -(-rest // piece)
        cuts = [whole + rest * i // parts for i in range(parts + 1)] if parts else []
        pieces += [Piece(len(docs) - 1, a, b - a) for a, b in zip(cuts, cuts[1:])]
        waiting += rest
        if waiting >= UNIT_WINDOWS * capacity * FILL:
            out += close()
            docs, pieces, waiting = [], [], 0
        if out:
            yield out
    if pieces:
        yield close()


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    capacity: int = CAPACITY,
    piece: int = PIECE,
) -> DataFrame:
    """One row per piece: document, place in it, window (``sequence_id``) and place there."""
    layout = id_type(tokenizer_path, end_id)
    tokens = tokenize(docs, tokenizer_path, end_id, layout)
    dealt = tokens.repartition("doc_id", "salt").sortWithinPartitions("doc_id", "salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        first_id = TaskContext.get().partitionId() << 40
        rows = (
            pair
            for batch in batches
            for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        )
        gathered = []
        for out in pack_share(rows, capacity, piece, first_id, layout):
            gathered += out
            if len(gathered) > 20_000:
                yield list(zip(*gathered))
                gathered = []
        if gathered:
            yield list(zip(*gathered))

    return map_arrow(dealt.select("doc_id", "ids"), _PIECES, run)
