"""Toxicity classifiers learned from confirmed toxic examples and unlabelled text.

Non-negative positive-unlabelled learning: labels tell some toxic documents and nothing else. With
``prior`` as the share of toxic documents, the risk of a score function f is

    prior * E_pos[loss(f)] + max(0, E_unl[loss(-f)] - prior * E_pos[loss(-f)])

with the sigmoid loss. The second term estimates the risk on clean text; where a batch estimates
it below zero the classifier has begun to fit the toxic examples in the unlabelled text, and the
step goes back up that term instead. Features are the distinct words of a text and their first
bytes, so that inflected forms of a toxic word count together.

Learning uses bounded samples, ``MAX_POSITIVE`` toxic examples and ``MAX_UNLABELLED`` texts, drawn
by a hash of the id; ``MEMBERS`` classifiers train in parallel, each without its own share of
them, and their mean is the model. It holds features of these samples only, so it is small enough to be sent to every task.
The prior comes from all labels that may be used, and every document is scored whole.

Defined results: an empty or null text is scored by the bias alone; without a toxic example every
score is the prior (0.0 without labels); labels that are null, and ids that have no document, are
passed over; repeated rows are scored alike; an empty table gives no rows. Only doc_id, text and
the labels' toxic are read, whatever other columns there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    DoubleType,
    StructField,
    StructType,
)

from dockpulse.llm.common import map_arrow, utf8
from dockpulse.llm.decontamination import words_of

MAX_POSITIVE = 4096
MAX_UNLABELLED = 12288
MEMBERS = 3
#: Lengths in bytes of the word beginnings that are features.
PREFIXES = (4, 5, 6)
#: A feature is learned if so many sampled texts of a member have it.
MIN_TEXTS = 3
#: Log-likelihood ratio from which a feature tells; chance reaches it once in some 30,000 features.
MIN_RATIO = 17.5


@dataclass
class Model:
    bias: float
    weights: dict[bytes, float]


def features(text: bytes) -> set[bytes]:
    """Distinct words, and their beginnings marked by a leading caret."""
    words = set(words_of(text.decode().lower().encode()))
    found = set(words)
    for n in PREFIXES:
        found.update([b"^" + w[:n] for w in words if len(w) > n])
    return found


def _rows_of(texts: list[bytes], known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    rows = [[known[f] for f in features(t) if f in known] for t in texts]
    lengths = np.array([len(r) for r in rows], np.int64)
    return np.concatenate([np.array(r, np.int64) for r in rows] or [np.empty(0, np.int64)]), lengths


def telling_features(positive: list[bytes], unlabelled: list[bytes]) -> list[bytes]:
    """Features that toxic texts have more often than unlabelled ones, beyond chance.

    Judged by the log-likelihood ratio of the two shares; texts hold many words that they share
    with few others, and a classifier of all of them would learn the sample by heart.
    """
    counts = []
    for texts in (positive, unlabelled):
        counter: Counter[bytes] = Counter()
        for text in texts:
            counter.update(features(text))
        counts.append(counter)
    names = sorted(f for f in counts[0].keys() | counts[1].keys() if counts[0][f] + counts[1][f] >= MIN_TEXTS)
    if not names:
        return []
    a, b = (np.array([c[f] for f in names], float) for c in counts)
    n, m = float(len(positive)), float(len(unlabelled))
    share = (a + b) / (n + m)

    def part(observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return observed * np.log(np.where(observed > 0, observed, 1) / np.where(expected > 0, expected, 1))

    ratio = 2 * (
        part(a, n * share) + part(b, m * share) + part(n - a, n * (1 - share)) + part(m - b, m * (1 - share))
    )
    more = a * m > b * n
    return [f for f, r, toxic in zip(names, ratio, more) if toxic and r >= MIN_RATIO]


def train(
    positive: list[bytes],
    unlabelled: list[bytes],
    prior: float,
    steps: int = 1000,
    batch: int = 512,
    rate: float = 0.05,
    decay: float = 1e-6,
    seed: int = 7,
) -> Model:
    """One linear classifier by Adam on the non-negative positive-unlabelled risk.

    Weights stay at zero or above: a toxic word is not made up for by any other.
    """
    if not positive or not unlabelled:
        return Model(float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))), {})
    names = telling_features(positive, unlabelled)
    known = {f: i for i, f in enumerate(names)}
    index, lengths = _rows_of(positive + unlabelled, known)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    n_pos, n_unl = len(positive), len(unlabelled)
    weights = np.zeros(len(names) + 1)  # the last is the bias
    weights[-1] = -1.0
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    rng = np.random.default_rng(seed)

    def outputs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.concatenate([index[starts[r] : starts[r + 1]] for r in rows] + [index[:0]])
        of = np.repeat(np.arange(len(rows)), lengths[rows])
        z = np.bincount(of, weights[at], len(rows)) + weights[-1]
        return z, at, of

    def add(gradient: np.ndarray, at: np.ndarray, of: np.ndarray, by_row: np.ndarray) -> None:
        gradient[:-1] += np.bincount(at, by_row[of], len(names))
        gradient[-1] += by_row.sum()

    step = 0
    while step < steps:
        order = rng.permutation(n_unl) + n_pos
        for begin in range(0, n_unl, batch):
            step += 1
            unl = order[begin : begin + batch]
            pos = rng.integers(0, n_pos, min(batch, n_pos))
            z_pos, at_pos, of_pos = outputs(pos)
            z_unl, at_unl, of_unl = outputs(unl)
            s_pos, s_unl = (1 / (1 + np.exp(-np.clip(z, -50, 50))) for z in (z_pos, z_unl))
            # loss(z) = sigmoid(-z) has the slope -s * (1 - s), and loss(-z) the same upwards.
            slope_pos = s_pos * (1 - s_pos) / len(pos)
            slope_unl = s_unl * (1 - s_unl) / len(unl)
            gradient = np.zeros_like(weights)
            if s_unl.mean() >= prior * s_pos.mean():
                add(gradient, at_pos, of_pos, -2 * prior * slope_pos)
                add(gradient, at_unl, of_unl, slope_unl)
            else:
                add(gradient, at_pos, of_pos, prior * slope_pos)
                add(gradient, at_unl, of_unl, -slope_unl)
            gradient[:-1] += decay * weights[:-1]
            mean = 0.9 * mean + 0.1 * gradient
            square = 0.999 * square + 0.001 * gradient**2
            corrected = np.sqrt(square / (1 - 0.999**step)) + 1e-8
            weights -= rate * (mean / (1 - 0.9**step)) / corrected
            np.maximum(weights[:-1], 0, out=weights[:-1])
    kept = np.flatnonzero(np.abs(weights[:-1]) > 1e-3)
    return Model(float(weights[-1]), {names[i]: float(weights[i]) for i in kept.tolist()})


def _share(key: Column, wanted: int, available: int) -> Column:
    """True for about ``wanted`` of ``available`` rows, by a hash of the key."""
    if available <= wanted:
        return F.lit(True)
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 40)) < int((1 << 40) * wanted / available)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    may_learn: Column,
    prior: float | None = None,
    max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED,
) -> Model:
    """The mean of the members' classifiers.

    ``may_learn`` is a condition on doc_id; rows without it are used neither with nor without
    their label.
    """
    usable = labels.select("doc_id", "toxic").where(may_learn & F.col("toxic").isNotNull())
    n_labels, n_positive = usable.agg(
        F.count(F.lit(1)), F.count(F.when(F.col("toxic") == 1, 1))
    ).first()
    if prior is None:
        prior = n_positive / n_labels if n_labels else 0.0
    texts = docs.select("doc_id", utf8("text").alias("body")).where(may_learn)
    n_texts = texts.count()
    toxic = (
        usable.where("toxic = 1")
        .where(_share(F.col("doc_id"), max_positive, n_positive))
        .select("doc_id")
        .distinct()
    )
    share = F.pmod(F.xxhash64("doc_id", F.lit("member")), F.lit(MEMBERS)).cast("int")
    member = F.explode(F.filter(F.array(*map(F.lit, range(MEMBERS))), lambda m: m != share))
    # Both sides are bounded: ids of at most some max_positive rows, and the sampled texts.
    positive = texts.join(F.broadcast(toxic), "doc_id").select(
        member.alias("member"), F.lit(1).alias("confirmed"), "doc_id", "body"
    )
    unlabelled = texts.where(_share(F.col("doc_id"), max_unlabelled, n_texts)).select(
        member.alias("member"), F.lit(0).alias("confirmed"), "doc_id", "body"
    )
    schema = StructType(
        [
            StructField("feature", BinaryType()),
            StructField("weight", DoubleType()),
        ]
    )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        groups: dict[int, tuple[list, list]] = {}
        for batch in batches:
            members, confirmed, bodies = (batch.column(i).to_pylist() for i in range(3))
            for m, c, body in zip(members, confirmed, bodies):
                groups.setdefault(m, ([], []))[c].append(body)
        for m, (unl, pos) in sorted(groups.items()):
            model = train(pos, unl, prior, seed=7 + m)
            pairs = [(None, model.bias), *model.weights.items()]
            yield [list(c) for c in zip(*pairs)]

    dealt = (
        positive.unionAll(unlabelled)
        .repartition("member")
        .sortWithinPartitions("member", "confirmed", "doc_id", F.xxhash64("body"))
        .select("member", "confirmed", "body")
    )
    learned = map_arrow(dealt, schema, learn)
    mean = learned.groupBy("feature").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"))
    rows = mean.collect()
    members = max((r.n for r in rows if r.feature is None), default=0)
    if not members:
        return Model(float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))), {})
    bias = next(r.w for r in rows if r.feature is None) / members
    return Model(bias, {bytes(r.feature): r.w / members for r in rows if r.feature is not None})


def score(docs: DataFrame, model: Model, carried: list[str]) -> DataFrame:
    """``doc``, a struct of the ``carried`` columns, and the ``score`` of each document."""
    kept = StructType([docs.schema[c] for c in carried])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([StructField("doc", kept), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        weights, bias = shared.value.weights, shared.value.bias
        for batch in batches:
            sums = []
            for text in batch.column(1).to_pylist():
                found = features(text) & weights.keys() if weights else ()
                sums.append(bias + sum(sorted(weights[f] for f in found)))
            z = np.clip(np.array(sums, float), -500, 500)
            yield [batch.column(0), pa.array(1 / (1 + np.exp(-z)))]

    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("doc"), utf8("text").alias("body")
    )
    return map_arrow(rows, schema, run)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: a fifth by CRC-32 of the id as text."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    rows = score(docs, model, docs.columns).where(F.col("score") < threshold)
    return rows.select("doc.*")
