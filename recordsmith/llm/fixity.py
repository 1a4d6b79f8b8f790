"""Fixity audit of WARC replicas by Merkle trees.

A record's leaf hashes its bytes' digest with its length; FANOUT neighbours hash into a node, each with the range of
offsets that it takes in the node, in the order of these, and so on up to one root for all files.  Two replicas compare their
roots, then only the children of nodes that differ, down to the records.  A record's slot follows from its number and
ranges count from a node's start, so a lost record changes the nodes above it and no others.  Everything is joins and groupings of small rows; a node has FANOUT children at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, no_clash, release

FANOUT = 16
#: Records of one file; a power of FANOUT, so that a file is a subtree.
FILE_RECORDS = FANOUT**3


def record(url: Column, payload: Column) -> Column:
    """Bytes of a response record, as text; a null URL or payload counts as empty."""
    url, payload = F.coalesce(url, F.lit("")), F.coalesce(payload, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"))
    return F.concat(head, F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"))


def leaves(records: DataFrame) -> DataFrame:
    """(page_id, record) -> (slot, page_id, n_bytes, digest, hash): a leaf for each page_id.

    Rows without page_id are left out.  Rows that repeat a page_id are one record: their digests, in order, hash as one.
    """
    each = no_clash(records, "page_id", "record").where("page_id is not null").select(
        F.col("page_id").cast("long").alias("page_id"), F.octet_length("record").cast("long").alias("n_bytes"), F.sha2("record", 256).alias("digest")
    )
    one = each.groupBy("page_id").agg(F.sum("n_bytes").alias("n_bytes"), F.min("digest").alias("digest"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("digest")), "").alias("all"))
    digest = F.when(F.col("n") == 1, F.col("digest")).otherwise(F.sha2(F.concat("all", F.col("n").cast("string")), 256))
    return one.select(F.col("page_id").alias("slot"), "page_id", "n_bytes", digest.alias("digest")).withColumn("hash", F.sha2(F.concat_ws(":", F.lit("leaf"), "slot", "n_bytes", "digest"), 256))


def tree(leaf: DataFrame, depth: int) -> list[DataFrame]:
    """Levels of (slot, first, last, n_bytes, hash), from the leaves to a level whose slots are 0 or -1."""
    level = leaf.select("slot", F.col("slot").alias("first"), F.col("slot").alias("last"), "n_bytes", "hash")
    out = [level]
    for _ in range(depth):
        kids = F.array_sort(F.collect_list(F.struct("slot", "n_bytes", "hash")))
        begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("ranges"))
        place = lambda acc, x: F.struct((acc["at"] + x["n_bytes"]).alias("at"), F.array_append(acc["ranges"], F.concat_ws("=", x["slot"], acc["at"], acc["at"] + x["n_bytes"], x["hash"])).alias("ranges"))
        level = level.groupBy(F.floor(F.col("slot") / FANOUT).alias("slot")).agg(
            F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n_bytes").alias("n_bytes"), F.aggregate(kids, begin, place, lambda acc: F.array_join(acc["ranges"], "|")).alias("children")
        )
        level = level.select("slot", "first", "last", "n_bytes", F.sha2(F.concat_ws(":", F.lit("node"), "first", "last", "n_bytes", "children"), 256).alias("hash"))
        if len(out) == 1:  # the levels above are a fraction of this one
            level = cut(level)
        out.append(level)
    return out


def depth_for(*leaf: DataFrame) -> int:
    """Levels above the leaves until every slot is 0 (or, of negative numbers, -1)."""
    span = max((r[0] or 0) for r in (df.agg(F.max(F.abs("slot"))).first() for df in leaf))
    depth = 1
    while span >= FANOUT**depth:
        depth += 1
    return depth


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Records (page_id, record) of two replicas -> a row for each record in which they differ.

    file_id, page_id, status (changed, lost, extra), start_offset and end_offset in the primary's file, expected_sha256,
    found_sha256.  Offsets of extra records are null.  Equal replicas, two empty ones too: no rows.
    """
    a, b = cut(leaves(primary)), cut(leaves(replica))
    depth = depth_for(a, b)
    mine, theirs = tree(a, depth), tree(b, depth)
    bad, seen = None, []
    for x, y in zip(mine[::-1], theirs[::-1]):
        if bad is not None:  # of either replica, only the children of nodes that differ are looked at
            x, y = (side.join(bad.select(F.col("slot").alias("parent")), F.floor(side["slot"] / FANOUT) == F.col("parent"), "left_semi") for side in (x, y))
        both = x.select("slot", F.col("hash").alias("expected")).join(y.select("slot", F.col("hash").alias("found")), "slot", "full")
        bad = cut(both.where(~F.col("expected").eqNullSafe(F.col("found"))).select("slot"))
        seen.append(bad)
    file_id = F.floor(F.col("page_id") / FILE_RECORDS)
    ends = F.sum("n_bytes").over(Window.partitionBy("file_id").orderBy("page_id"))
    files = bad.select(F.floor(F.col("slot") / FILE_RECORDS).alias("file_id")).distinct()  # offsets are only needed in these
    placed = a.withColumn("file_id", file_id).join(files, "file_id", "left_semi").withColumn("end_offset", ends).select("slot", (F.col("end_offset") - F.col("n_bytes")).alias("start_offset"), "end_offset", F.col("digest").alias("expected_sha256"))
    found = b.select("slot", F.col("digest").alias("found_sha256"))
    status = F.when(F.col("found_sha256").isNull(), "lost").when(F.col("expected_sha256").isNull(), "extra").otherwise("changed")
    located = bad.join(placed, "slot", "left").join(found, "slot", "left").withColumn("page_id", F.col("slot"))
    out = cut(located.select(file_id.alias("file_id"), "page_id", status.alias("status"), "start_offset", "end_offset", "expected_sha256", "found_sha256"))
    release(a, b, mine[1], theirs[1], *seen)
    return out
