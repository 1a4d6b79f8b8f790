"""What several operators of this package share: tables, checkpoints, Arrow slices and word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step holds; a longer document is a step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoints(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder, by spark.checkpoint.dir; where none is named, a temporary one in a local session and an error on a cluster."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))


#: Spark's setting by which an execution deletes its shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again, so that a lost executor costs no recomputation of what stands before.

    A table takes a fraction of the room of a checkpoint of the same rows, and the shuffles that made it are deleted.
    release() deletes the table.
    """
    spark = df.sparkSession
    shared_checkpoints(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables that cut() made and that nothing will read again."""
    for df in tables:
        if df is not None:
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(df._folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Freed memory goes back to the system; glibc would keep it in a driver or worker that lives on."""
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about ``step`` bytes of the text column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + step, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each followed by one line feed, as bytes; and the offset of each text plus the end. Null: empty."""
    texts = pc.fill_null(column.cast(pa.large_binary()), b"")
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths + 1, out=starts[1:])
    return np.frombuffer(b"\n".join(texts.to_pylist()) + b"\n", np.uint8), starts


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 22:
            _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums H and inverse powers R: the hash of data[a:b] is (H[b] - H[a]) * R[a], modulo 2**64."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", _BASE, len(data)), out=sums[1:])
    return sums, _power("down", _INVERSE, len(data) + 1)


def words(data: np.ndarray, starts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs of bytes other than white space (9-13, 32).

    Gives each word's hash, first byte and end, and for each text the index of its first word (plus the number of words).
    """
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate([[0], edge])
    first, last = edge[0::2], edge[1::2]
    sums, down = prefix_hash(_LOWER[data] if lower else data)
    return mix((sums[last] - sums[first]) * down[first]), first, last, np.searchsorted(first, starts)


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, in order, and the index of each text's first.

    A text of fewer than k words, but at least one, has a single shingle: all its words.
    """
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    at = np.repeat(bounds[:-1] - out[:-1], count) + np.arange(out[-1])
    acc = np.zeros(len(at), np.uint64)
    left = np.repeat(bounds[1:], count) - at
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    for j in range(k):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + np.where(left > j, padded[at + j], np.uint64(j + 1))
    return mix(acc), out


def no_clash(docs: DataFrame, *need: str) -> DataFrame:
    """Only the columns that an operator uses, so that others with clashing names do no harm."""
    return docs.select(*[F.col(f"`{c}`") for c in need])


def filtered_batches(docs: DataFrame, kept: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow of a filter over all columns, be their names such that Spark would take them apart; doc_id and text keep theirs."""
    inner = docs.toDF(*[c if c in ("doc_id", "text") else f"column{i}" for i, c in enumerate(docs.columns)])
    return inner.mapInArrow(kept, inner.schema).toDF(*docs.columns)


def first_in_order(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of a total order, with no task or driver seeing n rows of every partition: rows are dealt by
    range and sorted, and counts by partition tell which rows are first.  The result is materialised."""
    parts = partitions(df.sparkSession)
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = cut(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_place")))
    counts = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())
    last, left = -1, n
    for part, count in counts:
        last = part
        if count >= left:
            break
        left -= count
    return placed.where((F.col("_part") < last) | ((F.col("_part") == last) & (F.col("_place") < left))).drop("_part", "_place")


def hashed_sample(df: DataFrame, n: int, key: str) -> DataFrame:
    """Up to n rows by the order of their hashed keys; the same rows for the same table.  Few more than n are sorted."""
    count = df.count()
    place = F.xxhash64(key).bitwiseAND((1 << 62) - 1)
    if count > 4 * n:
        df = df.where(place < int(2.0 * n / count * (1 << 62)))
    return df.orderBy(place, key).limit(n)
