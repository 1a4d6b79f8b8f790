"""Cross-entropy difference of two matched bigram models (after Moore and Lewis, 2010).

Target and background model share one vocabulary: all words of all documents, and marks for a text's begin and end.
Both smooth towards unigrams by the same rule.  Each token's loss under the target model less its loss under the
background model, averaged over a text, is the text's score; low means like the target.  All counts are over all
documents.

A loss is -ln(c(v w) + prior * share(w)) + ln(c(v) + prior): the first part needs the pair's count and the word's, the
second only the count of the word before.  Pairs of very frequent words are counted in a table of fixed size and scored
where the text is.  Any other token is dealt by its word, where all its occurrences meet: their number, the counts of the
pairs they end and, as each is also the word before another, the second part.  A very frequent word after another word is
dealt by the pair.  Only sums by document come back.  Words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, first_in_order, joined_bytes, mix, partitions, no_clash, release, slices, words
from .packed import PIECES_PER_PARTITION, Packer, unpacked_by

#: Marks in place of a word's hash.
BEGIN, END = np.uint64(1), np.uint64(2)
#: The most frequent words, whose counts all tasks know, besides the marks.
HEAD = 510
UNIGRAM_PRIOR, BIGRAM_PRIOR = 0.1, 20.0
ROWS = 1 << 20
WANTED, BY_PAIR = 1, 2


@dataclass
class Head:
    """The marks and the most frequent words, by hash, with their counts [2, words] (row 0: background)."""

    hashes: np.ndarray
    counts: np.ndarray
    predicted: np.ndarray  # all tokens that a model predicts, [2]
    types: int  # different ones

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """Number of each token in the head, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, tokens), len(self.hashes) - 1)
        return np.where(self.hashes[at] == tokens, at, -1)

    def first(self, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
        """First part of the losses, of counts [2, n]."""
        share = (word + UNIGRAM_PRIOR) / (self.predicted[:, None] + UNIGRAM_PRIOR * self.types)
        return -np.log(pair + BIGRAM_PRIOR * share)


def second(before: np.ndarray) -> np.ndarray:
    return np.log(before + BIGRAM_PRIOR)


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words between its marks, and the text of each token."""
    data, starts = joined_bytes(batch.column("text"))
    hashes, _, _, bounds = words(data, starts, True)
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n + 2)
    out, ends = np.empty(len(doc), np.uint64), np.cumsum(n + 2)
    out[np.arange(len(hashes)) + 2 * np.repeat(np.arange(len(n)), n) + 1] = hashes
    out[ends - n - 2], out[ends - 1] = BEGIN, END
    return out, doc


def _wanted(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("target").to_numpy(zero_copy_only=False)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, t): how often, in all texts and in the target's; of the marks too."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word, n, t = map(np.concatenate, zip(*held))
        some, at = np.unique(word, return_inverse=True)
        return some, np.bincount(at, n), np.bincount(at, t)

    for batch in slices(batches, "text"):
        tokens, doc = _tokens(batch)
        held.append((tokens, np.ones(len(tokens)), _wanted(batch)[doc].astype(float)))
        held[:] = [merged()]
        if len(held[0][0]) > ROWS:
            yield from _count_rows(held.pop())
    if held:
        yield from _count_rows(held.pop())


def _count_rows(rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    word, n, t = rows
    yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(t.astype(np.int64))], ["word", "n", "t"])


def _doc_sums(rows: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(doc, ...) -> one row for each doc, with sums."""
    doc, *columns = map(np.concatenate, zip(*rows))
    some, at = np.unique(doc, return_inverse=True)
    return some, *[np.bincount(at, c, len(some)) for c in columns]


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted columns: where runs begin, and the run of each row."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def score(docs: DataFrame, target: Column) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_tokens, ce_target, ce_background, score), a row for each doc_id.

    ``target`` says which rows the target model counts (null: not); the background model counts all.  Words are runs of
    bytes other than white space, with A-Z lowered.  A text counts its end as a token, so an empty or null text has one.
    Rows with the same doc_id are scored as one document; rows without doc_id are left out.  Other columns are ignored.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("_target", F.coalesce(target, F.lit(False)))
    docs = no_clash(docs, "doc_id", "text", "_target").where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("_target").alias("target"))
    counted = cut(docs.select("text", "target").mapInArrow(_counted, "word long, n long, t long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("t").alias("t")))
    marks = F.col("word").isin(int(BEGIN), int(END))
    top = first_in_order(counted.where(~marks), HEAD, F.desc("n"), F.col("word")).collect() + counted.where(marks).collect()
    total = counted.where(F.col("word") != int(BEGIN)).agg(F.sum("n"), F.sum("t"), F.count(F.lit(1))).first()
    release(counted)
    top.sort(key=lambda r: r.word % (1 << 64))
    shared = spark.sparkContext.broadcast(
        Head(np.array([r.word % (1 << 64) for r in top], np.uint64), np.array([[r.n for r in top], [r.t for r in top]], float).reshape(2, -1), np.array([total[0] or 0, total[1] or 0], float), total[2])
    )
    size = len(top)

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size * size), np.int64)
        for batch in slices(batches, "text"):
            tokens, doc = _tokens(batch)
            at = shared.value.of(tokens)
            own = (doc[1:] == doc[:-1]) & (at[1:] >= 0) & (at[:-1] >= 0)
            cell, wanted = (at[:-1] * size + at[1:])[own], _wanted(batch)[doc[1:][own]]
            sums += np.stack([np.bincount(cell, minlength=size * size), np.bincount(cell[wanted], minlength=size * size)])
        some = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[0, some]), pa.array(sums[1, some])], ["cell", "n", "t"])

    cells = docs.select("text", "target").mapInArrow(headed, "cell long, n long, t long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    found = np.zeros((2, size * size))
    for r in cells.collect():  # (HEAD + 2) ** 2 at most
        found[:, r.cell] = r.n, r.t
    head = shared.value
    known = spark.sparkContext.broadcast((head.first(found, np.tile(head.counts, size)) + np.repeat(second(head.counts), size, axis=1)) if size else found)
    n_parts = partitions(spark)
    pieces = n_parts * PIECES_PER_PARTITION

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens by word or pair, in pieces; sums by document that are known here, in pieces beyond these."""
        packer, sums, held = Packer(2 * pieces, 4), Packer(2 * pieces, 4), []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                rows = [np.concatenate(c) for c in zip(*held)]
                order = np.argsort(rows[0])  # equal words next to each other take little room
                rows = [c[order] for c in rows]
                yield from packer.add((mix(rows[0]) % np.uint64(pieces)).astype(np.int64), *rows)
                yield from packer.flush()
            held.clear()

        for batch in slices(batches, "text"):
            tokens, doc = _tokens(batch)
            ids, at = batch.column("doc_id").to_numpy(), shared.value.of(tokens)
            pair = np.flatnonzero(doc[1:] == doc[:-1])
            v, w = at[pair], at[pair + 1]
            both = (v >= 0) & (w >= 0)
            doc = doc[pair]
            here = [np.bincount(doc[both], x, len(ids)) for x in known.value[:, v[both] * size + w[both]]]
            part = (v >= 0) & ~both
            here = [x + np.bincount(doc[part], y, len(ids)) for x, y in zip(here, second(shared.value.counts[:, v[part]]))]
            yield from sums.add(pieces + ids % pieces, ids, np.bincount(doc, minlength=len(ids)).astype(float), *here)
            flag = _wanted(batch)[doc].astype(np.uint8) * WANTED
            word = ~both & (w < 0)
            held.append((tokens[pair + 1][word], tokens[pair][word], ids[doc[word]], flag[word]))
            rest = ~both & (w >= 0)
            key = mix(tokens[pair][rest] * np.uint64(0xD6E8FEB86659FD93) + tokens[pair + 1][rest])
            held.append((key, w[rest].astype(np.uint64), ids[doc[rest]], flag[rest] | np.uint8(BY_PAIR)))
            if sum(len(h[0]) for h in held) > ROWS:
                yield from flush()
        yield from flush()
        yield from sums.flush()

    def losses(key: np.ndarray, other: np.ndarray, doc: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((other, key, flag & BY_PAIR))
        key, other, doc, flag = key[order], other[order], doc[order], flag[order]
        by_pair, one = flag & BY_PAIR, np.stack([np.ones(len(key)), (flag & WANTED).astype(float)])
        at, run = _runs(by_pair, key, other)
        pair = np.add.reduceat(one, at, axis=1)[:, run]
        at, run = _runs(by_pair, key)
        word = np.add.reduceat(one, at, axis=1)[:, run]
        by_pair = by_pair > 0
        loss = np.where(by_pair, 0.0, second(word))
        word[:, by_pair] = shared.value.counts[:, other[by_pair].astype(np.int64)]
        loss += shared.value.first(pair, word)
        return _doc_sums([(doc, np.zeros(len(doc)), *loss)])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held = Packer(pieces, 4), []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                rows = _doc_sums(held)
                yield from packer.add(rows[0] % pieces, *rows)
            held.clear()

        kinds = ([np.uint64, np.uint64, np.int64, np.uint8], [np.int64, np.float64, np.float64, np.float64])
        for piece, columns in unpacked_by(batches, lambda piece: kinds[piece >= pieces]):
            held.append(losses(*columns) if piece < pieces else tuple(columns))
            if sum(len(h[0]) for h in held) > ROWS:
                held[:] = [_doc_sums(held)]
                if len(held[0][0]) > ROWS:
                    yield from flush()
        yield from flush()
        yield from packer.flush()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, columns in unpacked_by(batches, lambda piece: [np.int64, np.float64, np.float64, np.float64]):
            doc, n, b, t = _doc_sums([tuple(columns)])
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(n.astype(np.int64)), pa.array(t / n), pa.array(b / n), pa.array((t - b) / n)], ["doc_id", "n_tokens", "ce_target", "ce_background", "score"])

    schema = "piece long, c0 binary, c1 binary, c2 binary, c3 binary"
    parts = docs.mapInArrow(sent, schema).repartition(n_parts, "piece").mapInArrow(met, schema).repartition(n_parts, "piece")
    return parts.mapInArrow(summed, "doc_id long, n_tokens long, ce_target double, ce_background double, score double")
