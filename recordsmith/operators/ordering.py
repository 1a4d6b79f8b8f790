"""Ranks, chunks and medians of groups of any size: no task sees a whole group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled

#: Rows of a column that are sorted in one task at the end of a selection.
SMALL = 10_000
#: Error bound of the pivots of a selection, as one in so many rows.
ACCURACY = 1_000


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """With each row's run of equal groups within the partition, and its place in the run; the group's hash and value stand last."""
    group, run, place = None, -1, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column("_group").to_numpy(zero_copy_only=False)
        new = np.append(own[0] != group, own[1:] != own[:-1])
        starts = np.flatnonzero(new)
        number = run + np.cumsum(new)
        first = np.full(len(own), -place, np.int64)
        if len(starts):
            first[starts[0] :] = np.repeat(starts, np.diff(np.append(starts, len(own))))
        at = np.arange(len(own)) - first
        group, run, place = own[-1], int(number[-1]), int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number), pa.array(at)], [*batch.schema.names, "_run", "_at"])


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """With each row's place, from 1, within its group in the order given; rows that the order does not tell apart in any order.

    Rows are dealt by ranges of group and order and numbered within each run; only a partition's first group can have begun
    in an earlier one, so that one number for each partition, the rows of that group before it, makes the numbers global.  Null is a
    group of its own.  The result is kept in the shared checkpoint folder.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [*[F.col(f"`{c}`") for c in by], *order] or [F.lit(0)]
    placed = rows.repartitionByRange(n, *sort).sortWithinPartitions(*sort)
    inner = placed.toDF(*[f"c{i}" for i in range(len(rows.columns))])  # whatever the names are
    keys = [F.col(f"c{rows.columns.index(c)}") for c in by]
    inner = inner.withColumn("_group", F.xxhash64(F.to_json(F.struct(*keys))) if by else F.lit(0).cast("long")).withColumn("_part", F.spark_partition_id())
    fields = ", ".join(f"`{c}` {t}" for c, t in inner.dtypes)
    numbered = settled(inner.mapInArrow(_runs, f"{fields}, _run long, _at long"))
    parts = numbered.groupBy("_part").agg(
        F.min_by("_group", F.struct("_run", "_at")).alias("first"), F.count_if(F.col("_run") == 0).alias("n_first"), F.max("_run").alias("runs"),
        F.max_by(F.struct("_group", "_at"), F.struct("_run", "_at")).alias("last"),
    )
    before, group, seen = [], None, 0
    for p in sorted(parts.collect(), key=lambda r: r["_part"]):  # a row for each partition
        carried = seen if p["first"] == group else 0
        before.append((p["_part"], carried))
        group, seen = p["last"]["_group"], (carried if p["runs"] == 0 else 0) + p["last"]["_at"] + 1
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "_part int, _before long"))
    out = numbered.join(offsets, "_part").withColumn("_rank", F.col("_at") + 1 + F.when(F.col("_run") == 0, F.col("_before")).otherwise(0))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rows.columns)], F.col("_rank").alias(name))


def chunked(rows: DataFrame, by: Sequence[str], order: Sequence[Column], value: Column, size: int = 1000) -> DataFrame:
    """(by, chunk, first, n, chunks, total, values): each group's values in order, in arrays of ``size``.

    Chunks count from 0; ``first`` is the rank of a chunk's first value.  ``chunks`` and ``total`` of the whole group stand with each chunk, so a reader knows
    from any of them whether it has all.  No rows: no chunks.
    """
    placed = ranked(rows.select(*[F.col(f"`{c}`") for c in by], F.struct(*order).alias("_order"), value.alias("_value")), by, [F.col("_order")], "_rank")
    chunk = F.floor((F.col("_rank") - 1) / size).alias("chunk")
    parts = placed.groupBy(*by, chunk).agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_value"))), lambda x: x["_value"]).alias("values"))
    sums = parts.groupBy(*by).agg(F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("total"))
    same = None
    for c in by:
        one = F.col(f"p.`{c}`").eqNullSafe(F.col(f"s.`{c}`"))
        same = one if same is None else same & one
    joined = parts.alias("p").join(sums.alias("s"), same) if by else parts.alias("p").crossJoin(F.broadcast(sums.alias("s")))  # one row
    return joined.select(*[F.col(f"p.`{c}`") for c in by], "chunk", (F.col("chunk") * size + 1).alias("first"), "n", "chunks", "total", "values")


def selected(values: DataFrame, wanted: Sequence[tuple[str, int]]) -> dict[tuple[str, int], float]:
    """(column, value) rows -> the values at the wanted (column, rank from 0), by narrowing ranges around them.

    Each round takes pivots on either side of a rank from a mergeable sketch of the rows still in range, counts exactly what
    lies below and between them, and goes on with the rows between.  When few are left, or all are one value, they are sorted.
    """
    spark = values.sparkSession
    state = {w: (None, None, w[1], None) for w in wanted}  # bounds, rank among the rows in range, their number
    found: dict[tuple[str, int], float] = {}
    schema = "target string, wanted long, low double, high double, at double, rank long"
    while state:
        sizes = [(c, k, lo, hi, None, rank) for (c, k), (lo, hi, rank, _) in state.items()]
        inside = values.join(F.broadcast(spark.createDataFrame(sizes, schema)), F.col("column") == F.col("target")).where((F.col("low").isNull() | (F.col("value") >= F.col("low"))) & (F.col("high").isNull() | (F.col("value") <= F.col("high"))))
        first = {(r.target, r.wanted): r.n for r in inside.groupBy("target", "wanted").agg(F.count(F.lit(1)).alias("n")).collect()} if any(s[3] is None for s in state.values()) else {}
        for w, (lo, hi, rank, n) in list(state.items()):
            state[w] = lo, hi, rank, first.get(w, 0) if n is None else n
        last = [w for w, (lo, hi, _, n) in state.items() if n <= SMALL]
        if last:
            few = inside.join(F.broadcast(spark.createDataFrame([(c, k) for c, k in last], "target string, wanted long")), ["target", "wanted"])
            place = F.row_number().over(Window.partitionBy("target", "wanted").orderBy("value")) - 1
            for r in few.withColumn("place", place).where("place = rank").select("target", "wanted", "value").collect():  # a value for each wanted one
                found[r.target, r.wanted] = r.value
            for w in last:
                del state[w]
            continue
        span = lambda w, d: min(1.0, max(0.0, (state[w][2] + d * 2 * state[w][3] / ACCURACY) / state[w][3]))
        pivots = {}
        for w in state:
            own = inside.where((F.col("target") == w[0]) & (F.col("wanted") == w[1]))
            pivots[w] = own.agg(F.percentile_approx("value", [span(w, -1), span(w, 1)], ACCURACY).alias("p")).first().p
        rows = [(c, k, pivots[c, k][0], pivots[c, k][1]) for c, k in state]
        bounds = F.broadcast(spark.createDataFrame(rows, "target string, wanted long, below double, above double"))
        counts = inside.join(bounds, ["target", "wanted"]).groupBy("target", "wanted").agg(F.count_if(F.col("value") < F.col("below")).alias("under"), F.count_if((F.col("value") >= F.col("below")) & (F.col("value") <= F.col("above"))).alias("within"), F.min(F.when(F.col("value") >= F.col("below"), F.col("value"))).alias("least"), F.max(F.when(F.col("value") <= F.col("above"), F.col("value"))).alias("most"))
        for r in counts.collect():  # a row for each wanted one
            w = (r.target, r.wanted)
            lo, hi, rank, n = state[w]
            if not r.under <= rank < r.under + r.within:
                raise ArithmeticError("the pivots do not enclose the rank")
            if r.least == r.most:
                found[w] = r.least
                del state[w]
            else:
                state[w] = r.least, r.most, rank - r.under, r.within
    return found
