"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def _hooked(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each node's larger neighbours go to its least neighbour.  Small star: the node and its smaller ones."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    moved = both.join(least, "a").where("b > a" if large else "b <> m").select(F.col("m").alias("a"), "b")
    if not large:
        moved = moved.union(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return moved.where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of long ids, a <> b -> (node, component): the least id that each linked node reaches.

    Nodes without links do not appear.  Every round is written to the shared folder, and the one before deleted; the number of rounds grows with the logarithm
    of the longest path.  No edges: an empty result.  The result is a table of cut().
    """
    state = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    seen = None
    while True:
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
        before, state = state, cut(_hooked(_hooked(state, True), False))
        release(before)
    roots = state.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    out = cut(state.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots))
    release(state)
    return out
