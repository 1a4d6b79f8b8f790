"""Toxicity: subword-bag embeddings, averaged, under a linear softmax (after Joulin et al., 2017).

A text is the average of the vectors of its words and of their character n-grams (as bytes, with word ends), so that a
misspelt word shares vectors with the word.  The average goes through a linear softmax.  Vectors and softmax are trained
together, in numpy, by gradient steps on minibatches of a bounded sample of labelled texts; tasks turn those texts into
bags first, so that the driver holds no texts.  A vector's step is scaled by the curvature along its n-gram, so that
common n-grams do not drown rare ones.  Training is repeated without each fold of the sample in turn: the models'
average is the model, and the folds that each has not seen tell what its scores mean.  For scoring, vectors and softmax
fold into one number for each n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, filtered_batches, give_back, joined_bytes, mix, no_clash, prefix_hash, slices
from .labelled import collected, held_out, training_sample

BUCKET_BITS = 18
SIZES = (3, 4, 5)
#: A word's own vector counts as so many n-grams.
WORD_COPIES = 3
#: An n-gram that fewer texts of the sample have counts as zero: it tells one text from the others, not a class.
MIN_TEXTS = 5
DIMENSION = 4
#: Texts of a step; texts that training goes through, repeats included; the step's size, for vectors and softmax alike.
BATCH, VISITS, RATE, RIDGE = 32, 6000, 4.0, 0.006
FOLDS = 3
#: How far classes of unequal size are balanced: 0 not at all, 1 fully.
BALANCE = 0.7
#: Shares of a text are taken in thousandths.
SCALE = 1000.0
THRESHOLD = 0.7

_APART = np.zeros(256, bool)
_APART[[*range(33), *map(ord, ".,!?;:|\"()[]{}<>/")]] = True


@dataclass
class Model:
    weight: np.ndarray  # of each bucket: its vector times the difference of the softmax's columns
    bias: float


def _read(texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(places, buckets) of the words, then of the n-grams of each size, and where each text's places start.

    An n-gram has white space at its ends only; the white space before a text is the text's own.
    """
    data, starts = joined_bytes(texts)
    low = np.concatenate([[np.uint8(10)], _LOWER[data]])
    apart = _APART[low]
    low = np.where(apart, np.uint8(32), low)
    edge = np.flatnonzero(apart[1:] != apart[:-1]) + 1
    if not apart[0]:
        edge = np.concatenate([[0], edge])
    first, last = edge[0::2], edge[1::2]
    sums, down = prefix_hash(low)
    shift = np.uint64(64 - BUCKET_BITS)
    kinds = [(first, mix(((sums[last] - sums[first]) * down[first]) ^ np.uint64(7)) >> shift)]
    inner = np.concatenate([[0], np.cumsum(apart)])
    n = len(low)
    for size in SIZES:
        if n < size + 1:
            continue
        at = np.flatnonzero(inner[size:] - inner[:-size] <= np.where(apart[: n - size + 1], 1, 0) + apart[size - 1 :])
        at = at[inner[at + size] - inner[at] < size - 1]
        kinds.append((at, mix(((sums[at + size] - sums[at]) * down[at]) ^ np.uint64(size << 8)) >> shift))
    return [(places, buckets.astype(np.int64)) for places, buckets in kinds], starts


Bag = tuple[np.ndarray, np.ndarray]


def bags(texts: pa.Array) -> list[Bag]:
    """The buckets of each text and their shares of it."""
    kinds, starts = _read(texts)
    doc = np.concatenate([np.searchsorted(starts, places, "right") - 1 for places, _ in kinds])
    count = np.concatenate([np.full(len(places), 1 if i else WORD_COPIES) for i, (places, _) in enumerate(kinds)])
    key, at = np.unique(doc.astype(np.int64) << BUCKET_BITS | np.concatenate([b for _, b in kinds]), return_inverse=True)
    total = np.bincount(at, count)
    row = key >> BUCKET_BITS
    share = (SCALE * total / np.bincount(row, total, len(texts))[row]).astype(np.float32)
    bucket, ends = (key & ((1 << BUCKET_BITS) - 1)).astype(np.int32), np.searchsorted(row, np.arange(len(texts) + 1))
    return [(bucket[a:b], share[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def _bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        own = bags(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("y"), *[pa.array([x[i].tobytes() for x in own], pa.binary()) for i in (0, 1)]], ["doc_id", "y", "buckets", "shares"]
        )


def _trained(own: list[Bag], y: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, float]:
    """Weight of each n-gram and bias."""
    rng, n = np.random.default_rng(seed), len(own)
    square = sum(np.bincount(b, s.astype(float) ** 2, size) for b, s in own) / n
    speed = 1 / (square + RIDGE)
    speed *= RATE / max((square * speed).sum(), 1e-9)
    weight = (1 - BALANCE) + BALANCE * np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    vectors, softmax, bias = rng.normal(0, 1e-3, (size, DIMENSION)), rng.normal(0, 0.5, (DIMENSION, 2)), np.zeros(2)
    steps = -(-VISITS // BATCH)
    order = np.concatenate([rng.permutation(n) for _ in range(-(-steps * BATCH // n))])
    for step in range(steps):
        some, left = order[step * BATCH : (step + 1) * BATCH], 1 - step / steps
        bucket, share = (np.concatenate([own[i][k] for i in some]) for k in (0, 1))
        row = np.repeat(np.arange(len(some)), [len(own[i][0]) for i in some])
        mean = np.stack([np.bincount(row, share * vectors[bucket, d], len(some)) for d in range(DIMENSION)], axis=1)
        z = mean @ softmax + bias
        off = np.exp(z - z.max(1, keepdims=True))
        off /= off.sum(1, keepdims=True)
        off[np.arange(len(some)), y[some]] -= 1
        off *= weight[some][:, None] / len(some)
        back = off @ softmax.T
        softmax = softmax - RATE * left * mean.T @ off / max(float((mean**2).sum(1).mean()), 1.0)
        for d in range(DIMENSION):
            vectors[:, d] -= left * speed * np.bincount(bucket, share * back[row, d], size)
        bias -= left * off.sum(0)
    return vectors @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0])


def _meaning(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Factor and shift that make logits of unseen texts probabilities, by Newton steps."""
    spread = float(z.std()) or 1.0
    x, p = np.stack([z / spread, np.ones(len(z))], axis=1), np.array([1.0, 0.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        p = p - np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (weight * (q - y)) + 1e-2 * p)
    return max(p[0], 0.0) / spread, float(p[1])


def fit_bags(own: list[Bag], labels: list[int], seed: int = 7) -> Model:
    """Train vectors and softmax together.  Without both classes: no opinion."""
    size = 1 << BUCKET_BITS
    if len(set(labels)) < 2:
        return Model(np.zeros(size), 0.0)
    y, texts = np.array(labels), np.zeros(size, np.int64)
    for bucket, _ in own:
        texts[bucket] += 1
    known = np.flatnonzero(texts >= min(MIN_TEXTS, len(own)))
    number = np.full(size, -1, np.int32)
    number[known] = np.arange(len(known))
    own = [(number[b][number[b] >= 0], s[number[b] >= 0]) for b, s in own]
    fold, rng = np.zeros(len(y), np.int64), np.random.default_rng(seed)
    for c in (0, 1):
        fold[rng.permutation(np.flatnonzero(y == c))] = np.arange((y == c).sum()) % FOLDS
    weight, bias, z, seen = np.zeros(len(known)), 0.0, np.zeros(len(y)), []
    for f in range(FOLDS):
        use = np.flatnonzero(fold != f)
        if len(set(y[use].tolist())) < 2:
            continue
        w, b = _trained([own[i] for i in use], y[use], len(known), seed + f)
        weight, bias = weight + w, bias + b
        for i in np.flatnonzero(fold == f):
            z[i] = own[i][1] @ w[own[i][0]] + b
        seen.append(f)
    rest = np.isin(fold, seen)
    factor, shift = _meaning(z[rest], y[rest], np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))[rest] ** BALANCE) if len(set(y[rest].tolist())) == 2 else (1.0, 0.0)
    whole = np.zeros(size)
    whole[known] = factor * weight / max(len(seen), 1)
    return Model(whole, factor * bias / max(len(seen), 1) + shift)


def fit(texts: pa.Array, labels: list[int], seed: int = 7) -> Model:
    """As fit_bags(), of texts at hand."""
    return fit_bags([bag for piece in slices(iter([pa.record_batch([texts], ["text"])]), "text") for bag in bags(piece.column(0))], labels, seed)


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    """Scores of 0 to 1; a text without words is an average of nothing and scores by the bias alone."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    kinds, starts = _read(texts)
    for i, (places, buckets) in enumerate(kinds):
        sums = np.concatenate([[0.0], np.cumsum(model.weight[buckets])])
        at, copies = np.searchsorted(places, starts), 1 if i else WORD_COPIES
        total += copies * (sums[at[1:]] - sums[at[:-1]])
        count += copies * (at[1:] - at[:-1])
    return 1 / (1 + np.exp(-np.clip(SCALE * total / np.maximum(count, 1) + model.bias, -500, 500)))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score_texts(batch.column("text"), model))], [*batch.schema.names, "score"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The driver gets the bags of the sampled texts: 2**BUCKET_BITS entries of eight bytes for each text at most."""
    rows = training_sample(docs, labels, "toxic").mapInArrow(_bagged, "doc_id long, y int, buckets binary, shares binary")
    y, buckets, shares = collected(rows, "buckets", "shares")
    model = fit_bags([(b.view(np.int32), s.view(np.float32)) for b, s in zip(buckets, shares)], y)
    del buckets, shares
    give_back()
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, held_out, score, predicted), a row for each row.

    Null and empty texts, and texts without words, have the score of an empty average.  Repeated rows are scored one by
    one; rows without doc_id stay and count as not held out.  Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    scored = no_clash(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: (b.select(["doc_id", "score"]) for b in _scored(it, sent.value)), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, whose text scores below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(score_texts(batch.column("text"), sent.value) < THRESHOLD))
        give_back()

    return filtered_batches(docs, kept)
