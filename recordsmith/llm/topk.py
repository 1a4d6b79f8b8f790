"""Exact top-k search by inner product: a ball tree per shard, branch and bound, and kth scores shared between shards.

Rows are dealt by hash into shards of bounded size; each shard's ball tree is built once and written.  A query meets the
shards in waves that grow eightfold: what it has found in earlier waves gives its kth score, which bounds the search of
all shards of the next.  In a shard, nodes are opened in the order of their upper bound, which is the inner product with the ball's
centre plus the query's length times the radius; nothing below the kth score is opened.  Equal scores are opened, for ties.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, no_clash, partitions, release

SHARD_ROWS, LEAST_SHARD_ROWS, LEAF_ROWS = 32_768, 2_048, 64
WAVES = (64, 8, 1)
#: Of an upper bound, for rounding.
SLACK = 1e-9
LONG = (1 << 63) - 1


def integers(vector: Column) -> Column:
    """floor(1024 * x) of each component; null for vectors that are null, empty, or hold null or non-finite components."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x)) & (F.size(vector) > 0)
    bounded = lambda x: F.floor(F.greatest(F.least(x.cast("double") * 1024, F.lit(2.0**62)), F.lit(-(2.0**62))))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vector, bounded))


def _small(matrix: np.ndarray) -> np.ndarray:
    """In the narrowest integers that hold it."""
    most = int(np.abs(matrix).max(initial=0))
    return matrix.astype(next(t for t in (np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


def inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows with a query; where they may pass 64 bits, as Python integers."""
    most = rows.shape[1] * int(np.abs(rows.astype(np.int64)).max(initial=0)) * int(np.abs(query).max(initial=0))
    if most < 1 << 53:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    kind = np.int64 if most < LONG else object
    return rows.astype(kind) @ query.astype(kind)


class BallTree:
    """Nodes in the order they were made; a node has two children or the rows start:stop of the reordered matrix."""

    FIELDS = ("ids", "rows", "centres", "radii", "left", "start", "stop")

    def __init__(self, *fields: np.ndarray):
        self.ids, self.rows, self.centres, self.radii, self.left, self.start, self.stop = fields

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS) -> BallTree:
        points, order = rows.astype(np.float64), np.arange(len(rows))
        centres, radii, left, start, stop = [], [], [], [], []

        def node(a: int, b: int) -> None:
            own = points[order[a:b]]
            centre = own.mean(0)
            centres.append(centre)
            radii.append(np.sqrt(((own - centre) ** 2).sum(1).max()))
            left.append(-1)
            start.append(a)
            stop.append(b)

        node(0, len(rows))
        at = 0
        while at < len(centres):
            a, b = start[at], stop[at]
            if b - a > leaf and radii[at] > 0:
                own = points[order[a:b]]
                one = own[np.argmax(((own - centres[at]) ** 2).sum(1))]
                other = own[np.argmax(((own - one) ** 2).sum(1))]
                along = np.argsort(own @ (other - one), kind="stable")
                order[a:b] = order[a:b][along]
                left[at] = len(centres)
                node(a, (a + b) // 2)
                node((a + b) // 2, b)
            at += 1
        return cls(ids[order], _small(rows[order]), np.array(centres), np.array(radii), np.array(left), np.array(start), np.array(stop))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> BallTree:
        held = np.load(io.BytesIO(blob))
        return cls(*[held[f] for f in cls.FIELDS])

    def search(self, own: int, query: np.ndarray, k: int, kth: int | None) -> list[tuple[int, int]]:
        """The k best (score, id), of those that reach kth; a row under the query's own id is none."""
        q = query.astype(np.float64)
        size = np.sqrt(q @ q)
        bounds = self.centres @ q + size * self.radii
        bounds += SLACK * (np.abs(bounds) + size * (np.sqrt((self.centres**2).sum(1)) + self.radii)) + SLACK
        best: list[tuple[int, int]] = []
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if kth is not None and -bound < kth:
                break
            if self.left[node] >= 0:
                for kid in (self.left[node], self.left[node] + 1):
                    if kth is None or bounds[kid] >= kth:
                        heapq.heappush(queue, (-bounds[kid], kid))
                continue
            a, b = self.start[node], self.stop[node]
            scores, ids = inner(self.rows[a:b], query), self.ids[a:b]
            fine = ids != own
            if kth is not None:
                fine &= (scores >= kth).astype(bool)
            if fine.any():
                best = sorted([*best, *zip(scores[fine].tolist(), ids[fine].tolist())], key=lambda x: (-x[0], x[1]))[:k]
                if len(best) == k:
                    kth = best[-1][0] if kth is None else max(kth, best[-1][0])
        return best


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


FOUND = "query_id long, query_vector long, vec_id long, exact string, score long"


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A shard's tree comes first, then the queries that meet it."""
    tree, names = None, [f.split()[0] for f in FOUND.split(", ")]
    for batch in batches:
        out: list[tuple] = []
        blobs, kth, own, key, v = (batch.column(c) for c in ("tree", "kth", "query_id", "query_vector", "v"))
        for i in range(batch.num_rows):
            if blobs[i].is_valid:
                tree = BallTree.load(blobs[i].as_py())
                continue
            least = int(kth[i].as_py()) if kth[i].is_valid else None
            query = v[i].values.to_numpy(zero_copy_only=False)
            for score, vec_id in tree.search(own[i].as_py(), query, k, least):
                out.append((own[i].as_py(), key[i].as_py(), vec_id, str(score), max(-LONG - 1, min(LONG, score))))
        columns = zip(*out) if out else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(vec_id, embedding, ...) -> (query_id, rank, vec_id, score, query_vector): the k rows of largest inner product for each query row.

    Components are floor(1024 * x), the score is their integer inner product; equal scores go to the smaller vec_id.  A row
    is no candidate of its own vec_id.  Rows without vec_id, and vectors that are null, empty, or hold null or non-finite
    components take no part; vectors of another size than the query's are no candidates.  Rows that repeat a vec_id are
    each a candidate; as queries, each different vector under a vec_id has its own answer (query_vector, a hash, tells
    them apart), equal ones one together.  Components are held within 2**62 and scores within a long, after ranking.  No
    usable vector: no rows.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.withColumn("_query", F.coalesce(is_query, F.lit(False)))
    rows = no_clash(rows, "vec_id", "embedding", "_query").select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("v"), F.col("_query").alias("asks"))
    rows = cut(rows.where("vec_id is not null and v is not null").withColumn("size", F.size("v")).withColumn("key", F.xxhash64("v")))
    least = F.least(F.lit(partitions(spark)), F.ceil(F.col("n") / LEAST_SHARD_ROWS))
    sizes = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).select("size", F.greatest(F.ceil(F.col("n") / SHARD_ROWS), least).cast("int").alias("shards"))
    sizes = cut(sizes)  # a row for each size of vector
    most = sizes.agg(F.max("shards")).first()[0] or 0

    def built(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["vec_id", "key"])
        tree = BallTree.build(own["vec_id"].to_numpy(), np.stack(own["v"].to_list()).astype(np.int64))
        return pd.DataFrame({"size": [key[0]], "shard": [key[1]], "tree": [tree.dump()]})

    dealt = rows.join(sizes, "size").withColumn("shard", F.pmod(F.xxhash64("vec_id", "key"), "shards").cast("int"))
    trees = cut(dealt.select("size", "shard", "vec_id", "key", "v").groupBy("size", "shard").applyInPandas(built, "size int, shard int, tree binary"))
    queries = cut(rows.where("asks").select("size", F.col("vec_id").alias("query_id"), F.col("key").alias("query_vector"), "v").distinct().join(sizes, "size"))
    exact = F.col("exact").cast("decimal(38,0)")
    order = Window.partitionBy("query_id", "query_vector").orderBy(F.desc(exact), "vec_id")
    found, first = cut(spark.createDataFrame([], FOUND + ", rank int")), 0
    for part in WAVES:
        last = -(-most // part)
        if last <= first:
            continue
        kth = found.groupBy("query_id", "query_vector").agg(F.count(F.lit(1)).alias("n"), F.min(exact).cast("string").alias("kth")).where(F.col("n") == k).drop("n")
        ends = F.least(F.lit(last), F.col("shards")) - 1
        asked = queries.where(F.col("shards") > first).join(kth, ["query_id", "query_vector"], "left")
        asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(first), ends))).select("size", "shard", F.lit(None).cast("binary").alias("tree"), "query_id", "query_vector", "v", "kth")
        here = trees.where((F.col("shard") >= first) & (F.col("shard") < last)).select("size", "shard", "tree", *[F.lit(None).cast(t).alias(c) for c, t in (("query_id", "long"), ("query_vector", "long"), ("v", "array<long>"), ("kth", "string"))])
        met = here.union(asked).repartition(max(partitions(spark), last - first), "size", "shard").sortWithinPartitions("size", "shard", F.col("tree").isNull())
        new = met.mapInArrow(lambda it: _searched(it, k), FOUND)
        before, found = found, cut(found.drop("rank").union(new).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        release(before)
        first = last
    release(rows, trees, queries, sizes)
    return found.select("query_id", "rank", "vec_id", "score", "query_vector")
