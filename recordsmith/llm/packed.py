"""Rows packed into compressed column blobs, by the piece that they are dealt to.

Millions of small rows cost more as rows than as arrays: a task packs what it has for a piece, the shuffle deals pieces,
and the receiving task unpacks them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import partitions

PIECES_PER_PARTITION = 4
ROWS = 1 << 20


class Packer:
    """Collects arrays of equal length, the first of which says the piece."""

    def __init__(self, pieces: int, columns: int):
        self.pieces, self.columns, self.held, self.rows = pieces, columns, [], 0
        self.small = zstandard.ZstdCompressor(level=1).compress

    def add(self, piece: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(piece):
            self.held.append((piece, *columns))
            self.rows += len(piece)
        if self.rows >= ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            piece, *columns = map(np.concatenate, zip(*self.held))
            order = np.argsort(piece, kind="stable")
            ends = np.searchsorted(piece[order], np.arange(self.pieces + 1))
            use = [i for i in range(self.pieces) if ends[i] < ends[i + 1]]
            blobs = [pa.array([self.small(c[order[ends[i] : ends[i + 1]]].tobytes()) for i in use], pa.binary()) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(use, pa.int64()), *blobs], ["piece", *[f"c{i}" for i in range(self.columns)]])
        self.held, self.rows = [], 0


def deal(df: DataFrame, pack: Callable[[Iterator[pa.RecordBatch], int], Iterator[pa.RecordBatch]], columns: int) -> DataFrame:
    """(piece, c0, c1, ...) dealt by piece; ``pack`` gets batches and the number of pieces."""
    n = partitions(df.sparkSession)
    pieces = n * PIECES_PER_PARTITION
    schema = "piece long, " + ", ".join(f"c{i} binary" for i in range(columns))
    return df.mapInArrow(lambda it: pack(it, pieces), schema).repartition(n, "piece")


def unpacked_by(batches: Iterator[pa.RecordBatch], kinds: Callable[[int], list[type]]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """One piece after the other with its columns, of kinds that depend on the piece; until its turn, it stays compressed."""
    large, by_piece = zstandard.ZstdDecompressor().decompress, {}
    for batch in batches:
        for piece, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
            by_piece.setdefault(piece, []).append(blobs)
    while by_piece:
        piece, blobs = by_piece.popitem()
        columns = []
        for i, kind in enumerate(kinds(piece)):
            columns.append(np.frombuffer(b"".join(large(b[i]) for b in blobs), kind))
            for b in blobs:
                b[i] = b""
        yield piece, columns


def unpacked(batches: Iterator[pa.RecordBatch], kinds: list[type]) -> Iterator[list[np.ndarray]]:
    """The columns of one piece after the other."""
    return (columns for _, columns in unpacked_by(batches, lambda _: kinds))
