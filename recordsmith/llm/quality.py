"""Quality: attention-based multiple-instance learning (after Ilse, Tomczak and Welling, 2018).

A document is a bag of passages.  Every passage is encoded from its bytes and words; gated attention weighs the encoded
passages, their weighted sum is the document's representation, and a logistic unit scores it.  Encoder, attention and
unit are trained together from document labels, in numpy, on all passages of a bounded sample of documents: of each
class, in the order of their hashed ids, as many as have FIT_PASSAGES passages together.  Tasks encode the sample, so that the
driver holds no texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, joined_bytes, no_clash, slices, words
from .labelled import collected, held_out, training_sample

PASSAGE_WORDS = 64
#: Passages of a class after which no further document joins the sample.
FIT_PASSAGES = 60_000
PAIRS = 64
HIDDEN, GATES = 24, 16
EPOCHS, BATCH, RATE, DECAY = 30, 32, 0.01, 1e-4

#: Kind of each byte: lower and upper letters, digits, white space, bytes beyond ASCII, and each other sign by itself.
_KIND = np.zeros(256, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:192], _KIND[192:] = 0, 1, 2, 3, 4
_KIND[[9, 11, 12, 13, 32]], _KIND[10] = 5, 6
_SIGNS = [b for b in range(33, 127) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)]
_KIND[_SIGNS] = 7 + np.arange(len(_SIGNS))
KINDS = 7 + len(_SIGNS)
FEATURES = KINDS + PAIRS + 5


def passages(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage, and how many passages each text has (one at least)."""
    hashes, first, last, bounds = words(data, starts, True)
    count = np.diff(bounds)
    each = np.maximum(-(-count // PASSAGE_WORDS), 1)
    begin = np.concatenate([[0], np.cumsum(each)])
    step = np.arange(begin[-1]) - np.repeat(begin[:-1], each)
    head = np.minimum(np.repeat(bounds[:-1], each) + step * PASSAGE_WORDS, np.repeat(bounds[1:], each))
    tail = np.minimum(head + PASSAGE_WORDS, np.repeat(bounds[1:], each))
    border = np.where(step == 0, np.repeat(starts[:-1], each), first[np.minimum(head, len(first) - 1)] if len(first) else 0)
    n, size = begin[-1], np.diff(np.append(border, len(data)))
    owner = np.repeat(np.arange(n), size)
    kind = _KIND[data]
    out = np.zeros((n, FEATURES))
    out[:, :KINDS] = np.bincount(owner * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS)
    pair = (data[:-1].astype(np.int64) * 257 + data[1:] * 31) % 4093 % PAIRS
    inside = np.ones(len(pair), bool)
    inside[starts[1:-1] - 1] = False  # from one text to the next
    out[:, KINDS:-5] = np.bincount((owner[:-1] * PAIRS + pair)[inside], minlength=n * PAIRS).reshape(n, PAIRS)
    out[:, :-5] = np.sqrt(out[:, :-5] / np.maximum(size, 1)[:, None])
    word = np.maximum(tail - head, 1)

    def of(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[tail] - total[head]) / word

    if len(hashes):
        same = lambda k: np.concatenate([np.zeros(min(k, len(hashes)), bool), hashes[k:] == hashes[:-k]])
        length = last - first
        out[:, -5], out[:, -4] = of(same(1)), of(same(2))
        out[:, -3], out[:, -2] = np.log1p(of(length)) / 2, of(length > 12)
    out[:, -1] = np.minimum(tail - head, PASSAGE_WORDS) / PASSAGE_WORDS
    return out, each


def _forward(x: np.ndarray, each: np.ndarray, p: dict[str, np.ndarray]) -> tuple:
    at = np.concatenate([[0], np.cumsum(each)[:-1]])
    h = np.maximum(x @ p["enc"] + p["enc_b"], 0)
    t, g = np.tanh(h @ p["att"]), 1 / (1 + np.exp(-(h @ p["gate"])))
    e = (t * g) @ p["pool"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), each))
    a = e / np.repeat(np.add.reduceat(e, at), each)
    bag = np.add.reduceat(a[:, None] * h, at)
    return h, t, g, a, bag, np.clip(bag @ p["out"] + p["out_b"][0], -30, 30), at


def fit_bags(bags: list[np.ndarray], labels: list[int], seed: int = 11) -> dict[str, np.ndarray] | None:
    """Adam on minibatches of documents.  Without both classes there is no model."""
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    stacked = np.concatenate(bags)
    mean, spread = stacked.mean(0), stacked.std(0) + 0.02
    bags = [(b - mean) / spread for b in bags]
    y = np.array(labels, float)
    scale = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {"enc": scale(FEATURES, HIDDEN), "enc_b": np.zeros(HIDDEN), "att": scale(HIDDEN, GATES), "gate": scale(HIDDEN, GATES), "pool": scale(GATES), "out": scale(HIDDEN), "out_b": np.zeros(1)}
    m, v, turn = {k: 0 * w for k, w in p.items()}, {k: 0 * w for k, w in p.items()}, 0
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), BATCH):
            use = order[k : k + BATCH]
            x, each = np.concatenate([bags[i] for i in use]), np.array([len(bags[i]) for i in use])
            h, t, g, a, bag, z, at = _forward(x, each, p)
            dz = (1 / (1 + np.exp(-z)) - y[use]) * weight[use] / len(use)
            dbag = np.repeat(dz[:, None] * p["out"], each, axis=0)
            da = (dbag * h).sum(1)
            de = a * (da - np.repeat(np.add.reduceat(a * da, at), each))
            dt, dg = de[:, None] * p["pool"] * g * (1 - t**2), de[:, None] * p["pool"] * t * g * (1 - g)
            dh = (dbag * a[:, None] + dt @ p["att"].T + dg @ p["gate"].T) * (h > 0)
            grads = {"enc": x.T @ dh, "enc_b": dh.sum(0), "att": h.T @ dt, "gate": h.T @ dg, "pool": (t * g).T @ de, "out": bag.T @ dz, "out_b": dz.sum(keepdims=True)}
            turn += 1
            for name, grad in grads.items():
                grad = grad + DECAY * p[name]
                m[name] = 0.9 * m[name] + 0.1 * grad
                v[name] = 0.999 * v[name] + 0.001 * grad**2
                p[name] = p[name] - RATE * (m[name] / (1 - 0.9**turn)) / (np.sqrt(v[name] / (1 - 0.999**turn)) + 1e-8)
    return p | {"mean": mean, "spread": spread}


def _bags(texts: pa.Array) -> list[np.ndarray]:
    x, each = passages(*joined_bytes(texts))
    return np.split(x, np.cumsum(each)[:-1])


def fit(texts: pa.Array, labels: list[int], seed: int = 11) -> dict[str, np.ndarray] | None:
    """As fit_bags(), of texts at hand."""
    return fit_bags([bag for piece in slices(iter([pa.record_batch([texts], ["text"])]), "text") for bag in _bags(piece.column(0))], labels, seed)


def _bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        own = pa.array([b.astype(np.float32).tobytes() for b in _bags(batch.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), own], ["doc_id", "y", "bag"])


def score_texts(texts: pa.Array, model: dict[str, np.ndarray] | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    x, each = passages(*joined_bytes(texts))
    return 1 / (1 + np.exp(-_forward((x - model["mean"]) / model["spread"], each, model)[5]))


def train(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray] | None:
    """The driver gets the encoded passages of the sampled texts: of each class FIT_PASSAGES and those of one more text."""
    sample = training_sample(docs, labels, "quality").withColumn("n", F.ceil(F.size(F.split("text", r"\s+")) / PASSAGE_WORDS))
    before = F.sum("n").over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1))  # a bounded sample
    sample = sample.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < FIT_PASSAGES).select("doc_id", "text", "y")
    y, bags = collected(sample.mapInArrow(_bagged, "doc_id long, y int, bag binary"), "bag")
    model = fit_bags([b.view(np.float32).reshape(-1, FEATURES).astype(float) for b in bags], y)
    del bags
    give_back()
    return model


def score_documents(docs: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, held_out, score, predicted), a row for each row.

    Null and empty texts are one passage without words.  Without a model (labels of one class only, or none) every score
    is 0.5.  Repeated rows are scored one by one; rows without doc_id stay, not held out.  Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_texts(batch.column("text"), sent.value))], ["doc_id", "score"])

    out = no_clash(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
