"""Size-aware heavy-light set similarity join on word n-grams (after Deng, Tao and Li, SIGMOD 2018).

A global order puts rare shingles first.  Two sets whose Jaccard similarity is t or more share at least
o = ceil(t * size) elements, hence k of the first size - o + k elements of either set.  Light sets (size up to a
boundary) enumerate all 2-subsets of that prefix for k = 2; heavy sets scan the inverted lists of their prefix for
k = 1, in which light sets near the boundary also stand.  The boundary is the one of least total cost, from
statistics over all sets.  Any order is right; the frequency order comes from a count sketch of fixed size over all
documents, so it needs no table of all shingles.

Copies with equal sets are one node from the start.  A key's members are not paired with each other: each node is
compared with the pivot that it shares most keys with, then with another, and only members that are still in different
components are paired at last, if as many prefix elements are shared as a link needs; so a group of near copies costs a
multiple of its size, and no link between components is lost.  Pairs are rows only if the parities of both sets, 256
bits each, differ in no more bits than similar sets differ in elements.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, joined_bytes, mix, no_clash, release, shingles, slices, words
from .graph import components

SKETCH_BITS = 18
PIECES = 64
#: Cost of one more partner on a list, in units of the cost of emitting and shuffling one key; it is small because a
#: member is compared with its list's pivot, not with every partner.
PAIR_COST = 1 / 64
#: Columns with the parities of how many elements of a set fall to each of 256 bits.
BITS = ("bits0", "bits1", "bits2", "bits3")
#: Times that keys are left out on which no other member can be similar.
PRUNED = 3
#: Times that members are compared with a pivot before what is left is paired.
ROUNDS = 2


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in slices(batches, "text"):
        data, starts = joined_bytes(batch.column("text"))
        hashes, _, _, bounds = words(data, starts, True)
        grams, at = shingles(hashes, bounds, k)
        yield batch, [np.unique(grams[a:b]) for a, b in zip(at[:-1], at[1:])]


def _sketch(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for _, sets in _sets(batches, k):
        counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
    if counts.any():
        for i, piece in enumerate(np.split(counts, PIECES)):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([piece.tobytes()])], ["piece", "counts"])
    give_back()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[piece] = total.get(piece, 0) + np.frombuffer(counts, np.int64)
    for piece, counts in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([counts.tobytes()])], ["piece", "counts"])


def frequency_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Occurrences of shingles over all documents, in 2**SKETCH_BITS counters (2 MB, whatever the input)."""
    parts = docs.mapInArrow(lambda it: _sketch(it, k), "piece long, counts binary")
    rows = parts.repartition(PIECES, "piece").mapInArrow(_summed, "piece long, counts binary").collect()
    out = np.zeros((PIECES, (1 << SKETCH_BITS) // PIECES), np.int64)
    for r in rows:
        out[r.piece] = np.frombuffer(r.counts, np.int64)
    return out.ravel()


def _overlap(size: int, percent: int) -> int:
    return -(-size * percent // 100)


def _alone(size: int, percent: int) -> bool:
    """Only an equal set can be so similar to a set of this size."""
    return size == 0 or 100 * size < percent * (size + 1)


def cheapest_boundary(rows: list[tuple[int, float, float, float]]) -> int:
    """Largest light set size: (size class, subsets, postings, partners) -> the size with the least total cost."""
    rows = sorted(rows)
    light = np.concatenate([[0], np.cumsum([r[1] for r in rows])])
    heavy = np.concatenate([np.cumsum([r[2] + PAIR_COST * r[3] for r in rows][::-1])[::-1], [0]])
    best = int(np.argmin(light + heavy))
    return int(2 ** (rows[best][0] / 8)) if best < len(rows) else 1 << 62


def _prefixes(batches: Iterator[pa.RecordBatch], k: int, percent: int, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each set's size, signature, first elements in order and how many partners are expected on the lists of these."""
    usual = sketch.mean() + 3 * np.sqrt(sketch.mean())
    for batch, sets in _sets(batches, k):
        one, two, prefixes, partners = [], [], [], []
        for items in sets:
            one.append(int(items.sum(dtype=np.uint64).view(np.int64)) if len(items) else 0)
            two.append(int(mix(items ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)) if len(items) else 0)
            if _alone(n := len(items), percent):
                prefixes.append(np.zeros(0, np.int64))
                partners.append(0.0)
                continue
            spare = n - _overlap(n, percent)
            freq = sketch[(items >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            if spare + 2 < n // 2:  # only the least frequent elements need be sorted
                some = np.flatnonzero(freq <= np.partition(freq, spare + 1)[spare + 1])
                items, freq = items[some], freq[some]
            order = np.lexsort((items, freq))[: spare + 2]
            prefixes.append(items[order].view(np.int64))
            partners.append(float(np.maximum(freq[order[: spare + 1]] - usual, 0).sum()))
        ends = np.cumsum([0, *map(len, prefixes)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes)))
        size = np.array([len(s) for s in sets], np.int64)
        place = np.repeat(np.arange(len(sets)), size) * 256 + (mix(np.concatenate(sets) + np.uint64(1)) & np.uint64(255)).astype(np.int64)
        parity = np.packbits((np.bincount(place, minlength=256 * len(sets)) & 1).astype(np.uint8).reshape(len(sets), 256), axis=1, bitorder="little").view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(size), pa.array(one, pa.int64()), pa.array(two, pa.int64()), lists, pa.array(partners), *[pa.array(np.ascontiguousarray(parity[:, i])) for i in range(4)]],
            ["doc_id", "n_shingles", "sig1", "sig2", "prefix", "partners", *BITS],
        )
    give_back()


def _keyed(batches: Iterator[pa.RecordBatch], percent: int, boundary: int) -> Iterator[pa.RecordBatch]:
    """The keys of each set with a prefix: pairs of its elements (odd numbers) for a light one, the elements but the last
    (even numbers) for a heavy one, and both near the boundary."""
    for batch in batches:
        column = batch.column("prefix")
        flat = column.flatten().to_numpy().view(np.uint64)
        ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
        keys = []
        for n, first, end in zip(batch.column("size").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
            ordered, own = flat[first:end], []
            spare = n - _overlap(n, percent)
            if len(ordered):
                if n <= boundary and n - spare >= 2:
                    i, j = np.triu_indices(spare + 2, 1)
                    own.append(mix(ordered[i] * np.uint64(0x9E3779B97F4A7C15) + ordered[j]) | np.uint64(1))
                if n > boundary or 100 * n >= percent * (boundary + 1) or n - spare < 2:
                    own.append(ordered[: spare + 1] & ~np.uint64(1))
            keys.append(np.unique(np.concatenate(own)).view(np.int64) if own else np.zeros(0, np.int64))
        count = [len(x) for x in keys]
        at = pa.array(np.repeat(np.arange(len(keys)), count))
        yield pa.RecordBatch.from_arrays([batch.column("node").take(at), batch.column("size").take(at), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))], ["node", "size", "key"])


def _similar(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(iter([batch]), "x"):
            y, at = pc.unique(part.column("y")), {}
            for name, column in (("x", part.column("x")), ("y", y)):
                at[name] = [s for _, sets in _sets(iter([pa.record_batch([column], ["text"])]), k) for s in sets]
            which = pc.index_in(part.column("y"), y).to_pylist()
            keep = []
            for x, i in zip(at["x"], which):
                both = len(np.intersect1d(x, at["y"][i], assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(at["y"][i]) - both))
            yield part.select(["a", "b"]).filter(pa.array(keep))
    give_back()


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Texts take half the room of their sets, so that the joins move texts."""
    x = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    y = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(lambda it: _similar(it, k, percent), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_shingles, component_id), a row for each input row with a doc_id.

    Documents link when 100 * shared shingles >= percent * shingles of both; component_id is the least doc_id that
    links reach.  Words are runs of bytes other than white space, with A-Z lowered; fewer than k words are one shingle.
    Null or empty texts, and texts of white space, have no shingles and link with nothing.  A doc_id that repeats gives
    a row for each of its rows; rows without a doc_id are left out.  Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = no_clash(docs, "doc_id", "text").where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = spark.sparkContext.broadcast(frequency_sketch(docs, k))
    schema = "doc_id long, n_shingles long, sig1 long, sig2 long, prefix array<long>, partners double, " + ", ".join(f"{b} long" for b in BITS)
    made = cut(docs.mapInArrow(lambda it: _prefixes(it, k, percent, sketch.value), schema))
    postings = F.size("prefix") - 1
    stats = (
        made.where(F.size("prefix") > 0).groupBy(F.floor(8 * F.log2("n_shingles")).alias("size_class"))
        .agg(F.sum((postings + 1) * postings / 2), F.sum(postings), F.sum("partners")).collect()
    )
    boundary = cheapest_boundary([tuple(r) for r in stats]) if stats else 0

    signature = ["n_shingles", "sig1", "sig2"]
    nodes = made.where("n_shingles > 0").groupBy(*signature).agg(F.min(F.struct("doc_id", "prefix", *BITS)).alias("least"))
    nodes = cut(nodes.select(*signature, F.col("least.doc_id").alias("node"), *[F.col(f"least.{c}").alias(c) for c in ("prefix", *BITS)]))

    postings = nodes.select("node", F.col("n_shingles").alias("size"), "prefix").mapInArrow(lambda it: _keyed(it, percent, boundary), "node long, size long, key long")
    postings = postings.withColumn("single", F.lit(1 << 40)).withColumn("double", F.lit(1 << 40))
    old = None
    for _ in range(PRUNED):
        postings = cut(_viable(postings, percent))
        release(old)
        old = postings
    # an id of several texts has no bits of its own
    bits = nodes.groupBy("node").agg(*[F.when(F.count(F.lit(1)) == 1, F.min(c)).alias(c) for c in BITS])
    postings = cut(postings.join(bits, "node"))
    release(old)
    texts = cut(docs.join(postings.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text"))

    links, label, members = None, None, ("node", "size", "single", "double", "component", *BITS)
    at = postings.withColumn("component", F.col("node"))
    for turn in range(ROUNDS):
        # first the member that shares the largest part of its prefix, most often the text that the others are copies of
        order = (-(F.col("single") + F.sqrt("double")) / F.col("size"), F.col("node")) if turn == 0 else (F.xxhash64("node", F.lit(turn)), F.col("node"))
        pivot = at.groupBy("key").agg(
            F.min(F.struct(*order, *[F.col(c).alias(f"b_{c}") for c in members])).alias("p"),
            F.min("component").alias("low"), F.max("component").alias("high"),
        ).where("low < high").select("key", *[f"p.b_{c}" for c in members])
        near = at.join(pivot, "key").where((F.col("component") != F.col("b_component")) & _may_link(percent) & _near(percent))
        best = near.groupBy("node", "b_node").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.max(F.struct("n", "b_node")).alias("best"))
        found = cut(_verified(best.select(F.col("node").alias("a"), F.col("best.b_node").alias("b")), texts, k, percent))
        if turn and found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        old, label = label, components(links)
        release(old)
        at = _labelled(postings, label)
    rest = at.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    left = at.join(rest, "key")
    right = left.select("key", *[F.col(c).alias(f"b_{c}") for c in members])
    sharing = left.join(right, "key").where((F.col("node") < F.col("b_node")) & (F.col("component") != F.col("b_component")) & _may_link(percent) & _near(percent))
    sharing = sharing.groupBy("node", F.col("b_node").alias("b"), "size", "b_size").agg(*[F.count_if(F.col("key") % 2 == odd).alias(c) for odd, c in ((0, "single"), (1, "double"))])
    sharing = sharing.select("*", F.col("single").alias("b_single"), F.col("double").alias("b_double"), F.when(F.col("single") > 0, 0).otherwise(1).alias("key"))
    sharing = sharing.where(_may_link(percent) & ((F.col("double") == 0) | _may_link(percent, F.lit(1))))
    found = cut(_verified(sharing.select(F.col("node").alias("a"), "b"), texts, k, percent))
    if not found.isEmpty():
        old, label = label, components(links.unionByName(found))
        release(old)
    release(postings, texts)
    nodes = _labelled(nodes.select(*signature, "node"), label).select(*signature, F.col("component").alias("component_id"))
    # sets without elements are left out of the join, so that they are no hot key
    joined = made.where("n_shingles > 0").select("doc_id", *signature).join(nodes, signature).select("doc_id", "n_shingles", "component_id")
    return joined.unionByName(made.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _viable(postings: DataFrame, percent: int) -> DataFrame:
    """Keys of a node on which some other member can be similar to it; and how many of them the node has, by kind.

    Of two members each is the other's only partner.  Of more, every size on the list's range might stand there: what
    may be shared behind a prefix less what a link needs grows with the partner's size but for steps of one, by its two
    ceilings, so that it is greatest at the largest size or a few below it, or at the least.  A similar pair keeps all
    keys that it shares.
    """
    keys = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("low"), F.max("size").alias("high")).where("n > 1")
    size, other = F.col("size"), F.col("low") + F.col("high") - F.col("size")
    most = F.when(F.col("n") == 2, other).otherwise(F.least("high", F.floor(size * 100 / F.lit(float(percent)) + F.lit(1e-9))))
    least = F.when(F.col("n") == 2, other).otherwise(F.greatest("low", F.ceil(size * percent / F.lit(100.0) - F.lit(1e-9))))
    near = postings.join(keys, "key").select("*", most.alias("most"), least.alias("least"))
    slack = F.greatest(_slack(percent, size, F.col("least")), *[_slack(percent, size, F.greatest("least", F.col("most") - d)) for d in range(_steps(percent) + 1)])
    fits = (100 * F.least("size", "most") >= percent * F.greatest("size", "most")) | (100 * F.least("size", "least") >= percent * F.greatest("size", "least"))
    kept = near.where(fits & _enough(F.col("key") % 2 != 0, F.col("single"), F.col("double"), slack)).select("node", "size", "key")
    shares = kept.groupBy("node").agg(F.count_if(F.col("key") % 2 == 0).alias("single"), F.count_if(F.col("key") % 2 != 0).alias("double"))
    return kept.join(shares, "node")


def _may_link(percent: int, key: Column | None = None) -> Column:
    """Whether sets that share a key can be similar, by their sizes and by how many keys they share, or share at most.

    What two sets share beyond their shared prefix elements lies behind either prefix.  Even keys are prefix elements,
    odd ones pairs of them; what follows a prefix is one less than the set's least overlap, or two less with pairs.
    """
    odd = (F.col("key") if key is None else key) % 2 != 0
    b_size = F.col("b_size")
    enough = _enough(odd, F.least("single", "b_single"), F.least("double", "b_double"), _slack(percent, F.col("size"), b_size))
    return enough & (100 * F.least(F.col("size"), b_size) >= percent * F.greatest(F.col("size"), b_size))


def _near(percent: int) -> Column:
    """Whether sets can be similar by their bits, of which each element that only one of them has changes one."""
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"b_{c}"))) for c in BITS[1:]), F.bit_count(F.col(BITS[0]).bitwiseXOR(F.col(f"b_{BITS[0]}"))))
    return F.coalesce((100 + percent) * apart <= (100 - percent) * (F.col("size") + F.col("b_size")), F.lit(True))


def _slack(percent: int, a: Column, b: Column) -> Column:
    """The greater of two sets' least overlaps, less the elements that both must share to be similar."""
    least = lambda c: F.ceil(c * percent / F.lit(100.0) - F.lit(1e-9))
    return F.greatest(least(a), least(b)) - least((a + b) * 100 / F.lit(100.0 + percent))


def _steps(percent: int) -> int:
    """Sizes below the largest partner at which the slack can still be greater: it is within one of a line that rises by
    t * t / (1 + t) a size, for a similarity t."""
    return -(-2 * 100 * (100 + percent) // percent**2)


def _enough(odd: Column, single: Column, double: Column, slack: Column) -> Column:
    elements = (1 + F.sqrt(1 + 8 * double)) / 2
    return F.when(odd, elements - 2 + slack >= 0).otherwise(single - 1 + slack >= 0)


def _labelled(df: DataFrame, label: DataFrame) -> DataFrame:
    return df.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))

