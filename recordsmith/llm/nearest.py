"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample and sent to all tasks; every row is then put into its leaf.  A query takes leaves in
the order in which their nodes are near.  How many leaves a query visits is calibrated: for some bounded number of rows,
which the tree was not fitted on, the exact neighbours among all rows are found by brute force, and the visits widen until
the leaves seen hold the wished share of those neighbours.  A query goes on to as many leaves as hold k rows; if most of
these are its own, it visits all leaves.

Rows are shuffled once, by leaf, and written as tiles: matrices of rows of one leaf.  Queries are written as packs: matrices
of queries with a bit for each query and leaf.  Tiles and packs meet as written, where a bit is set, without a shuffle, so
that no vector is copied for the leaves that a query visits; a matrix product rules out nearly all pairs of a tile and a
pack, and the others are measured exactly.  A task gives back k rows at most for each of its queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import cut, hashed_sample, no_clash, partitions, release

#: Rows that the tree is fitted on: a fiftieth of the table, within these bounds, so that leaves grow late.
SAMPLE_SHARE, SAMPLE_ROWS, MOST_SAMPLE_ROWS = 50, 20_000, 200_000
CALIBRATION_ROWS = 200
BRANCHES, LEAF_SAMPLE, ITERATIONS = 8, 64, 8
RECALL = 0.97
#: Of a tile or pack: rows, and bytes of its vectors as doubles.
MATRIX_ROWS, MATRIX_BYTES = 2048, 1 << 20
#: Rows whose tiles are one task's, at most and, on many cores, at least; packs that are one task's.
TASK_ROWS, LEAST_TASK_ROWS, TASK_PACKS = 1 << 18, 1 << 13, 8
#: Numbers that one numpy step holds.
CELLS = 1 << 20


@dataclass
class Tree:
    """Node 0 is the root; a node has either children or a leaf number."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    @cached_property
    def levels(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """From the root down, the nodes of each level and their parents."""
        out, level = [], [0]
        while level := [(kid, node) for node in level for kid in self.children[node]]:
            out.append(tuple(np.array(level).T))
            level = [kid for kid, _ in level]
        return out

    @cached_property
    def matrix(self) -> tuple[np.ndarray, np.ndarray]:
        """All centres, and the node of each leaf."""
        leaf = np.array(self.leaf)
        return np.stack(self.centres), np.flatnonzero(leaf >= 0)[np.argsort(leaf[leaf >= 0])]

    def order(self, queries: np.ndarray) -> np.ndarray:
        """Each query's leaves, best bin first: a leaf's turn comes with the farthest of the centres on the way to it, then with its own."""
        centres, leaves = self.matrix
        far = (centres**2).sum(1) - 2 * queries @ centres.T
        turn = far.copy()
        turn[:, 0] = -np.inf
        for nodes, parents in self.levels:
            turn[:, nodes] = np.maximum(turn[:, nodes], turn[:, parents])
        return np.lexsort((far[:, leaves], turn[:, leaves]), axis=1)

    def visited(self, queries: np.ndarray, limit: int, sizes: np.ndarray, rows: int) -> np.ndarray:
        """Whether a query visits a leaf: ``limit`` of them, or as many as have ``rows`` rows."""
        out = np.zeros((len(queries), self.leaves), bool)
        step = max(1, CELLS // len(self.centres))
        for at in range(0, len(queries), step):
            order = self.order(queries[at : at + step])
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            np.put_along_axis(out[at : at + step], order, (np.arange(self.leaves) < limit) | (before < rows), axis=1)
        return out

    def place(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest centre at every level."""
        out, todo = np.zeros(len(rows), np.int64), [(0, np.arange(len(rows)))]
        while todo:
            node, own = todo.pop()
            if self.leaf[node] >= 0 or not len(own):
                out[own] = self.leaf[node]
                continue
            kids = self.children[node]
            near = _nearest(rows[own], np.stack([self.centres[k] for k in kids]))
            todo += [(kid, own[near == i]) for i, kid in enumerate(kids) if (near == i).any()]
        return out


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * rows @ centres.T, axis=1)


def fit(rows: np.ndarray, seed: int = 5) -> Tree:
    rng, tree = np.random.default_rng(seed), Tree()

    def node(own: np.ndarray, centre: np.ndarray) -> int:
        number = len(tree.centres)
        tree.centres.append(centre)
        tree.children.append([])
        tree.leaf.append(-1)
        distinct = np.unique(own, axis=0) if len(own) > LEAF_SAMPLE else own
        if len(distinct) <= LEAF_SAMPLE:
            tree.leaf[number], tree.leaves = tree.leaves, tree.leaves + 1
            return number
        centres = distinct[rng.choice(len(distinct), BRANCHES, replace=False)]
        for _ in range(ITERATIONS):
            near = _nearest(own, centres)
            for i in range(len(centres)):
                if (near == i).any():
                    centres[i] = own[near == i].mean(0)
        near = _nearest(own, centres)
        parts = [(centres[i], own[near == i]) for i in range(len(centres)) if (near == i).any()]
        if len(parts) == 1:
            tree.leaf[number], tree.leaves = tree.leaves, tree.leaves + 1
            return number
        tree.children[number] = [node(part, c) for c, part in parts]
        return number

    node(rows, rows.mean(0) if len(rows) else np.zeros(1))
    return tree


def usable(vector: str) -> Column:
    """Not null nor zero, without null or non-finite components.  A NaN is greater than all numbers."""
    v = F.col(vector)
    low, high = F.array_min(v), F.array_max(v)
    fine = (low > -float("inf")) & (high < float("inf")) & ((low != 0) | (high != 0)) & ~F.exists(v, F.isnull)
    return F.coalesce(fine, F.lit(False))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Best:
    """The k nearest rows so far of each of some queries, ties to the smaller id; a row is none of its own id."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, k: int):
        self.ids, self.points, self.k = ids, points, k
        self.far, self.found, self.notes = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64)
        with np.errstate(over="ignore"):
            self.squares = (points**2).sum(1)
        self.wide = np.concatenate([points, np.ones((len(points), 1))], 1)

    def meet(self, ids: np.ndarray, rows: np.ndarray, note: int = 0, which: np.ndarray | None = None) -> None:
        """Set rows against the queries ``which`` (all).  A product gives squared distances less the query's square; what they
        leave within rounding of the kth distance is measured."""
        which = np.arange(len(self.ids)) if which is None else which
        with np.errstate(over="ignore", invalid="ignore"):
            squares = (rows**2).sum(1)
            wide, most = np.concatenate([-2 * rows, squares[:, None]], 1).T, squares.max(initial=0)
            own = np.isin(self.ids[which], ids)
            step = max(1, CELLS // max(1, len(ids)))
            for at in range(0, len(which), step):
                some = which[at : at + step]
                last, slack = self.far[some, -1], 1e-15 * (rows.shape[1] + 8) * (self.squares[some] + most)
                near, bound = self.wide[some] @ wide, last**2 - self.squares[some]
                measured = np.isfinite(slack)  # the others' squares pass what a double holds
                near[~measured] = 0
                for i in np.flatnonzero(own[at : at + step]):
                    near[i, ids == self.ids[some[i]]] = np.inf
                new = np.flatnonzero(np.isinf(last) & measured)
                if len(new) and len(ids) > self.k:
                    bound[new] = np.partition(near[new], self.k - 1, axis=1)[:, self.k - 1]
                i, j = np.divmod(np.flatnonzero(near <= np.where(measured, bound + slack, np.inf)[:, None]), max(1, len(ids)))
                other = np.isfinite(near[i, j])
                self._measure(some, last, i[other], j[other], ids, rows, note)

    def _measure(self, some: np.ndarray, last: np.ndarray, i: np.ndarray, j: np.ndarray, ids: np.ndarray, rows: np.ndarray, note: int) -> None:
        far, step = np.empty(len(i)), max(1, CELLS // max(1, rows.shape[1]))
        for at in range(0, len(i), step):
            part = slice(at, at + step)
            far[part] = np.sqrt(((rows[j[part]] - self.points[some[i[part]]]) ** 2).sum(1))
        use = np.isfinite(far) & (far <= last[i])
        if not use.any():
            return
        touched, place = np.unique(i[use], return_inverse=True)
        into = some[touched]
        place = np.concatenate([np.repeat(np.arange(len(into)), self.k), place])
        far, found = np.concatenate([self.far[into].ravel(), far[use]]), np.concatenate([self.found[into].ravel(), ids[j[use]]])
        notes = np.concatenate([self.notes[into].ravel(), np.full(use.sum(), note)])
        order = np.lexsort((found, far, place))
        best = order[np.searchsorted(place[order], np.arange(len(into)))[:, None] + np.arange(self.k)]
        self.far[into], self.found[into], self.notes[into] = far[best], found[best], notes[best]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query's place, id, distance and note of all that is found."""
        query, rank = np.nonzero(np.isfinite(self.far))
        return query, self.found[query, rank], self.far[query, rank], self.notes[query, rank]


def _runs(batches: Iterator[pa.RecordBatch], by_leaf: bool) -> Iterator[pa.RecordBatch]:
    """Batches put together or cut so that a vector's size allows; by leaf, with rows of one leaf each."""
    held, rows, now = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        most = min(MATRIX_ROWS, max(1, MATRIX_BYTES // (8 * len(batch.column("embedding")[0]))))
        leaf = batch.column("leaf").to_numpy() if by_leaf else np.zeros(batch.num_rows, np.int64)
        edges = [0, *(np.flatnonzero(np.diff(leaf)) + 1), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            while start < end:
                if held and (leaf[start] != now or rows == most):
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, rows = [], 0
                take = min(end - start, most - rows)
                held.append(batch.slice(start, take))
                start, rows, now = start + take, rows + take, leaf[start]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _blob(array: np.ndarray) -> pa.Array:
    return pa.array([array.tobytes()], pa.binary())


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, recall: float = RECALL) -> DataFrame:
    """(vec_id, embedding, ...) -> (query_id, rank, vec_id, score): the k nearest rows found for each query row.

    Score is the Euclidean distance in double precision on the original vectors; equal distances go to the smaller
    vec_id.  A row is no neighbour of its own vec_id.  Rows without vec_id, and vectors that are null, zero, of another
    size than most, or hold null or non-finite components take no part.  Rows that repeat a vec_id are each a candidate; as
    queries, each different vector under a vec_id has its own answer, and equal ones one together.  No usable vector: no
    rows.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    kind, dtype = ("float", np.float32) if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else ("double", np.float64)
    rows = vectors.withColumn("_query", F.coalesce(is_query, F.lit(False)))
    rows = no_clash(rows, "vec_id", "embedding", "_query").where(F.col("vec_id").isNotNull() & usable("embedding"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"), "_query")
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("embedding") == sizes.n)
    share = min(max(sizes["count"] // SAMPLE_SHARE, SAMPLE_ROWS), MOST_SAMPLE_ROWS) + CALIBRATION_ROWS
    sample = hashed_sample(rows.select("vec_id", "embedding"), share, "vec_id").toArrow()
    points, n = _vectors(sample.column("embedding").combine_chunks()), CALIBRATION_ROWS
    fitted, probes = (points[:-n], slice(len(points) - n, None)) if len(points) > 4 * n else (points, slice(0, n))
    tree = spark.sparkContext.broadcast(fit(fitted))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = pa.array(tree.value.place(_vectors(batch.column("embedding"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, leaf], [*batch.schema.names, "leaf"])

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, True):
            yield pa.RecordBatch.from_arrays([run.column("leaf").slice(0, 1), pa.array([run.num_rows]), _blob(run.column("vec_id").to_numpy()), _blob(_vectors(run.column("embedding")).astype(dtype))], ["leaf", "rows", "ids", "vectors"])

    # ranges of a leaf and a hash, so that a leaf of many rows is several tasks'
    indexed = cut(rows.mapInArrow(put, f"vec_id long, embedding array<{kind}>, _query boolean, leaf long"))
    dealt = indexed.drop("_query").repartitionByRange(max(partitions(spark), _share(sizes["count"], TASK_ROWS)), "leaf", F.xxhash64("vec_id", "embedding"))
    tiles = cut(dealt.sortWithinPartitions("leaf").mapInArrow(tiled, "leaf long, rows long, ids binary, vectors binary"))
    queries = cut(indexed.where("_query").select("vec_id", "embedding", "leaf").distinct().withColumn("query_key", F.xxhash64("embedding")))
    release(indexed)
    visits = _calibrated(tiles, dtype, sample.column("vec_id").to_numpy()[probes], points[probes], tree, k, recall)
    held = np.zeros(tree.value.leaves, np.int64)
    for r in tiles.groupBy("leaf").agg(F.sum("rows").alias("rows")).collect():  # leaves of the tree
        held[r.leaf] = r.rows

    def packed(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, False):
            own = _vectors(run.column("embedding"))
            visited = tree.value.visited(own, limit, held, k + 1)
            bits = np.ascontiguousarray(np.packbits(visited, axis=0).T)
            visitors = pa.array([[b.tobytes() if some else None for b, some in zip(bits, visited.any(0))]], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([_blob(run.column("vec_id").to_numpy()), _blob(run.column("query_key").to_numpy()), _blob(own.astype(dtype)), visitors], ["query_ids", "query_keys", "queries", "visitors"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: dict[int, tuple[Best, np.ndarray]] = {}
        for batch in batches:
            for i, pack in enumerate(batch.column("pack").to_pylist()):
                array = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)  # noqa: B023, E731
                if pack not in packs:
                    query_ids = array("query_ids", np.int64).copy()
                    packs[pack] = (Best(query_ids, array("queries", dtype).astype(np.float64).reshape(len(query_ids), -1), k), array("query_keys", np.int64).copy())
                ids, best = array("ids", np.int64), packs[pack][0]
                which = np.flatnonzero(np.unpackbits(array("visitors", np.uint8), count=len(best.ids)))
                best.meet(ids, array("vectors", dtype).astype(np.float64).reshape(len(ids), -1), which=which)
        for best, keys in packs.values():
            query, vec_id, far, _ = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (best.ids[query], keys[query], vec_id, far)], ["query_id", "query_key", "vec_id", "score"])

    def answered(queries: DataFrame, limit: int) -> DataFrame:
        count = queries.count()
        cores = spark.sparkContext.defaultParallelism
        packs = queries.repartitionByRange(_share(count, TASK_PACKS * MATRIX_ROWS), "leaf", "vec_id").sortWithinPartitions("leaf", "vec_id")
        packs = packs.mapInArrow(lambda it: packed(it, limit), "query_ids binary, query_keys binary, queries binary, visitors array<binary>")
        packs = cut(packs.withColumn("pack", F.monotonically_increasing_id()))
        few = tiles.coalesce(max(_share(sizes["count"], TASK_ROWS), min(2 * cores, _share(sizes["count"], LEAST_TASK_ROWS))))
        visitors = F.element_at("visitors", (F.col("leaf") + 1).cast("int"))
        pairs = few.join(packs.hint("shuffle_replicate_nl"), visitors.isNotNull()).withColumn("visitors", visitors)
        near = pairs.select("ids", "vectors", "pack", "query_ids", "query_keys", "queries", "visitors").mapInArrow(found, "query_id long, query_key long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy("score", "vec_id"))
        near = cut(near.withColumn("rank", rank).where(F.col("rank") <= k))
        release(packs)
        return near

    near = answered(queries, visits)
    met = near.groupBy("query_id", "query_key").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"), "query_key")
    lacking = queries.join(met, ["vec_id", "query_key"], "left_anti")
    if visits < tree.value.leaves and sizes["count"] > k and not lacking.isEmpty():
        near = near.join(met.withColumnRenamed("vec_id", "query_id"), ["query_id", "query_key"], "left_semi").unionByName(answered(lacking, tree.value.leaves))
    release(tiles, queries)
    return near.select("query_id", "rank", "vec_id", "score")


def _share(rows: int, most: int) -> int:
    return max(1, -(-rows // most))


def _calibrated(tiles: DataFrame, dtype: type, ids: np.ndarray, points: np.ndarray, tree, k: int, recall: float) -> int:
    """Least number of leaves, visited best bin first, that hold the wished share of the exact neighbours."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(ids, points, k)
        for batch in batches:
            for leaf, own, rows in zip(*(batch.column(c).to_pylist() for c in ("leaf", "ids", "vectors"))):
                own = np.frombuffer(own, np.int64)
                best.meet(own, np.frombuffer(rows, dtype).astype(np.float64).reshape(len(own), -1), leaf)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.rows()], ["q", "vec_id", "score", "leaf"])

    near = tiles.select("leaf", "ids", "vectors").mapInArrow(exact, "q long, vec_id long, score double, leaf long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    wanted = near.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "leaf").collect()  # k for each calibration row
    place = np.argsort(tree.value.order(points), axis=1)
    needed = np.sort([place[r.q][r.leaf] + 1 for r in wanted])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 1
