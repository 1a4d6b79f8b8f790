"""The bounded sample of labelled documents on which a classifier is fitted."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, no_clash

#: Labelled documents of each class that a classifier is fitted on, at most.
SAMPLE_PER_CLASS = 1500


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(doc_id, text, y) of up to ``per_class`` documents of each class, by the order of their hashed ids.

    Held-out rows, rows without label, and ids in disagreement are not used.  A null text is empty; of different texts
    under one doc_id the least is taken.
    """
    known = no_clash(labels, "doc_id", label).where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z").select("doc_id", "y")
    picked = [hashed_sample(known.where(F.col("y") == y), per_class, "doc_id") for y in (0, 1)]
    few = F.broadcast(picked[0].union(picked[1]))  # at most 2 * per_class pairs of numbers
    rows = no_clash(docs, "doc_id", "text").join(few, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("y").cast("int").alias("y"))
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))


def collected(rows: DataFrame, *columns: str) -> tuple[list[int], *tuple[list[np.ndarray], ...]]:
    """Labels, and bytes of each column, of few rows (doc_id, y, columns...) in the order of their ids, without copies."""
    table = rows.toArrow()
    order, out = np.argsort(table.column("doc_id").to_numpy()), []
    for name in columns:
        views: list[np.ndarray] = []
        for chunk in table.column(name).chunks:
            _, offsets, data = chunk.buffers()
            ends = np.frombuffer(offsets, np.int32, len(chunk) + 1, chunk.offset * 4)
            raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            views += [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        out.append([views[i] for i in order])
    return table.column("y").to_numpy()[order].tolist(), *out
