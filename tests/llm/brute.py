"""Plain single-process versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import xxhash

#: Columns that operators use themselves, to clash with.
CLASHING = ("id", "tag", "place", "key", "n", "words", "doc", "score", "bucket", "salt", "fp", "text_key")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def edge_rows(seed: int = 3) -> list[tuple]:
    """(doc_id, text): nulls, empty, blank, very long, repeated, near and passage-sharing texts."""
    rng = random.Random(seed)
    words = ["the", "of", "alpha", "beta", "gamma", "delta", "épsilon", "Zeta,", "eta.", "θήτα"]
    passage = " ".join(rng.choice(words) + str(rng.randrange(1000)) for _ in range(70))
    long_text = "\n".join(
        " ".join(rng.choice(words) + str(rng.randrange(90)) for _ in range(12)) for _ in range(900)
    )
    line = "A line of text that several documents repeat"
    rows = [
        (1, None),
        (2, ""),
        (3, " \n\t\n"),
        (4, "one two"),
        (5, long_text),
        (6, long_text.replace("alpha1 ", "other ", 3)),
        (7, long_text),
        (8, "x" * 1500),
        (9, "na " * 400),
        (None, "a document without an id\n" + line),
        (None, passage),
        (12, f"{line}\n\nshort\n{line.upper()}  \nlast words"),
        (12, f"  {line}\nother text of the same id"),
        (13, f"{line}\r\nand more"),
        (14, line),
        (14, line),
        (15, f"begin {passage} end"),
        (16, f"{passage} tail of its own that is long enough to matter here"),
        (17, f"before it {passage} tail of its own that is long enough to matter here"),
        (18, passage),
    ]
    for i in range(40, 60):
        text = [rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 200))]
        rows.append((i, " ".join(text)))
    rng.shuffle(rows)
    return rows


def as_docs(spark, rows):
    """Documents with the usual columns and clashing ones."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(i, t, "en", None, len(t or "")) for i, t in rows]
    docs = spark.createDataFrame(full, schema)
    for name in CLASHING:
        docs = docs.selectExpr("*", f"'kept' AS {name}")
    return docs.repartition(3)


def lines(rows, min_chars=20, min_docs=3):
    def key(line):
        return re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", line).translate(
            {c: c + 32 for c in range(65, 91)}
        )

    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        kept, all_lines = [], (text or "").split("\n")
        for line in all_lines:
            held = holders.get(key(line), ())
            keeper = max((h for h in held if h is not None), default=None)
            if len(held) < min_docs or keeper == i:
                kept.append(line)
        out.append((i, len(all_lines), len(all_lines) - len(kept), sha("\n".join(kept).encode())))
    return out


def repeated_bytes(rows, length=400):
    count = Counter()
    for _, text in rows:
        data = (text or "").encode()
        count.update(data[p : p + length] for p in range(len(data) - length + 1))
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - length + 1):
            if count[data[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), sum(gone), spans, sha(kept)))
    return out


def earlier_passages(rows, length=13):
    low = -(1 << 63)
    first = {}
    split = [(low if i is None else i, i, (text or "").encode().split()) for i, text in rows]
    for order, _, words in split:
        for p in range(len(words) - length + 1):
            key = tuple(words[p : p + length])
            first[key] = min(first.get(key, order), order)
    out = []
    for order, i, words in split:
        gone = [False] * len(words)
        for p in range(len(words) - length + 1):
            if first[tuple(words[p : p + length])] < order:
                gone[p : p + length] = [True] * length
        kept = [w for w, g in zip(words, gone) if not g]
        out.append((i, len(words), sum(gone), b" ".join(kept).decode()))
    return out


def simhash(text, shingle=3):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[p : p + shingle]) for p in range(max(len(words) - shingle + 1, 1))]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(prints, radius=2):
    """Component id of each (doc_id, fingerprint)."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for x, (i, _) in enumerate(prints):
        if i is not None:
            least[root(x)] = min(least.get(root(x), i), i)
    return [(i, f, least.get(root(x))) for x, (i, f) in enumerate(prints)]


def contamination(rows, items, window=10):
    def split(text):
        folded = (text or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)

    windows = defaultdict(set)
    for name, text in items:
        words = split(text)
        size = min(len(words), window)
        for p in range(len(words) - size + 1 if words else 0):
            windows[tuple(words[p : p + size])].add("" if name is None else str(name))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in rows:
        words, found = split(text), set()
        hit = [False] * len(words)
        for size in sizes:
            for p in range(len(words) - size + 1):
                names = windows.get(tuple(words[p : p + size]))
                if names:
                    found |= names
                    hit[p : p + size] = [True] * size
        out.append((i, len(words), sum(hit), sorted(found)))
    return out
