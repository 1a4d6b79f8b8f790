"""Phrase collocation mining by depth-limited count tries.

Each task counts the phrases of its shard in a trie of the wished depth, which is serialised sorted: level by level, the
children of a node next to each other, in the order of their paths' hashes.  Tries are cut into ranges of their first
edge (a pair of words), dealt by range, and the runs of a range are merged k ways from the top: a level's children are only looked
at where their parent is frequent in the sum of all shards.  Walking down the merged trie gives each phrase's left parts;
its suffix link leads to the phrase without the first word, and the links of that one to all right parts.

A phrase can only be frequent if all pairs of words in it are.  Before the tries, pairs are counted by hashed bucket in a
table of fixed size; a bucket's sum bounds its pairs' counts from above, so that a trie has no edge for pairs that are
surely rare.  This drops no frequent phrase, however full the table is.  Words, paths and langs are known by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER, cut, joined_bytes, mix, no_clash, partitions, prefix_hash, release, slices

#: Buckets of the pair table: one for each eight bytes of text, within these bounds.
LEAST_BITS, MOST_BITS, BYTES_PER_BUCKET = 16, 26, 8
TABLE_PARTS, PIECE_BYTES = 64, 8 << 20
WORDS_HELD = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PAIR = np.uint64(0xD6E8FEB86659FD93)
WORD, RANGE = 0, 1

_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = 2


def path(parent: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a path that goes on by a word; a lang's hash is the path of no words."""
    return mix(parent * _STEP + word)


def lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Shard:
    """The words of some texts: hashes, places, langs, and whether the next word is in the same piece."""

    def __init__(self, batch: pa.RecordBatch):
        self.data, starts = joined_bytes(batch.column("text"))
        kind = _KIND[self.data]
        edge = np.flatnonzero((kind[1:] > 0) != (kind[:-1] > 0)) + 1
        if len(kind) and kind[0] == 0:
            edge = np.concatenate([[0], edge])
        self.first, self.last = edge[0::2], edge[1::2]
        sums, down = prefix_hash(_LOWER[self.data])
        self.word = mix((sums[self.last] - sums[self.first]) * down[self.first])
        langs = batch.column("lang").to_pylist()
        each = np.array([lang_hash(x) for x in langs], np.uint64)
        doc = np.searchsorted(starts, self.first, "right") - 1
        self.names = dict(zip(each.tolist(), langs))
        self.lang = each[doc]
        piece = np.cumsum(kind == 2)[self.first] if len(kind) else self.first
        self.joins = np.append(piece[1:] == piece[:-1], False) if len(piece) else np.zeros(0, bool)
        self.pair = np.zeros(len(self.word), np.uint64)
        self.pair[:-1] = mix(path(self.lang[:-1], self.word[:-1]) * _PAIR + self.word[1:])

    def text(self, i: int) -> str:
        return _LOWER[self.data[self.first[i] : self.last[i]]].tobytes().decode("utf-8", "replace")


def _counts_of_words_and_pairs(batches: Iterator[pa.RecordBatch], bits: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of words (lang, lh, word, text, f), and at the end the shard's table of pairs in parts (part, blob)."""
    pairs = np.zeros(1 << bits, np.uint8 if most < 256 else np.uint32)
    words: dict[tuple[int, int], list] = {}
    squeeze = zstandard.ZstdCompressor(level=1).compress

    def rows() -> pa.RecordBatch:
        columns = [[], [], [], [], []]
        for (lang, word), (name, text, n) in words.items():
            for c, v in zip(columns, (name, lang - (1 << 64) if lang >> 63 else lang, word - (1 << 64) if word >> 63 else word, text, n)):
                c.append(v)
        words.clear()
        none = pa.nulls(len(columns[0]))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], COUNTED)

    for batch in slices(batches, "text"):
        shard = Shard(batch)
        if not len(shard.word):
            continue
        key = path(shard.lang, shard.word)
        _, at, n = np.unique(key, return_index=True, return_counts=True)
        for i, c in zip(at.tolist(), n.tolist()):
            lang, word = int(shard.lang[i]), int(shard.word[i])
            seen = words.get((lang, word))
            if seen:
                seen[2] += c
            else:
                words[lang, word] = [shard.names[lang], shard.text(i), c]
        if len(words) > WORDS_HELD // 4:
            yield rows()
        bucket, n = np.unique(shard.pair[shard.joins] >> np.uint64(64 - bits), return_counts=True)
        bucket = bucket.astype(np.int64)
        pairs[bucket] = np.minimum(pairs[bucket] + n.astype(np.int64), most)
    if words:
        yield rows()
    size = len(pairs) // TABLE_PARTS
    some = [p for p in range(TABLE_PARTS) if pairs[p * size : (p + 1) * size].any()]
    none = pa.nulls(len(some))
    blobs = [squeeze(pairs[p * size : (p + 1) * size].tobytes()) for p in some]
    yield pa.RecordBatch.from_arrays([none.cast(pa.string()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.string()), none.cast(pa.int64()), pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], COUNTED)


COUNTED = ["lang", "lh", "word", "text", "f", "part", "blob"]
COUNTED_SCHEMA = "lang string, lh long, word long, text string, f long, part int, blob binary"


def _frequent_buckets(batches: Iterator[pa.RecordBatch], bits: int, most: int) -> Iterator[pa.RecordBatch]:
    """Tables summed by part -> (part, bits of the buckets that reach the count)."""
    kind, size, sums = np.uint8 if most < 256 else np.uint32, (1 << bits) // TABLE_PARTS, {}
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist()):
            own = sums.setdefault(part, np.zeros(size, kind))
            np.minimum(own + np.frombuffer(expand(blob), kind).astype(np.int64), most, out=own, casting="unsafe")
    parts = list(sums)
    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([np.packbits(sums[p] >= most).tobytes() for p in parts], pa.binary())], ["part", "bits"])


def tries(batches: Iterator[pa.RecordBatch], depth: int, pieces: int, bits: int, mask: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(piece, trie) runs of each shard."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            lang, word, joins = map(np.concatenate, zip(*held))
            held.clear()
            yield from _serialised(lang, word, joins, depth, pieces)

    for batch in slices(batches, "text"):
        shard = Shard(batch)
        if len(shard.word):
            bucket = (shard.pair >> np.uint64(64 - bits)).astype(np.int64)
            joins = shard.joins & ((mask[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1).astype(bool)
            use = joins.copy()
            use[1:] |= joins[:-1]  # words of no pair that may be frequent need not be kept
            held.append((shard.lang[use], shard.word[use], joins[use]))
        if sum(len(h[0]) for h in held) > WORDS_HELD:
            yield from flush()
    yield from flush()


def _serialised(lang: np.ndarray, word: np.ndarray, joins: np.ndarray, depth: int, pieces: int) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(joins)
    if not len(at):
        return
    squeeze = zstandard.ZstdCompressor(level=3).compress
    names, number = np.unique(word, return_inverse=True)
    keys, reach, span = [path(path(lang[at], word[at]), word[at + 1])], [at], at
    for d in range(2, depth):
        going = joins[span + d - 1]
        span = span[going]
        if not len(span):
            break
        keys.append(path(keys[-1][going], word[span + d]))
        reach.append(span)
    # in the order of the first edge's hash, then of its child's, and so on: sort starts once by their paths
    full = [np.zeros(len(at), np.uint64) for _ in keys]
    for level, (key, span) in enumerate(zip(keys, reach)):
        full[level][np.searchsorted(at, span)] = key
    order = np.lexsort(full[::-1])
    start, levels, parent = at[order], [], None
    for level in range(len(keys)):
        key = full[level][order]
        has = key != 0
        new = has.copy()
        new[1:] &= key[1:] != key[:-1]
        first = np.flatnonzero(new)
        node = np.cumsum(new) - 1
        count = np.bincount(node[has], minlength=len(first))
        kids = None if parent is None else np.bincount(parent[first], minlength=len(levels[-1][0]))
        levels.append((key[first], start[first], count, kids))
        parent = node
    top = levels[0]
    piece = (top[0] >> np.uint64(32)).astype(np.int64) * pieces >> 32
    edges = np.searchsorted(piece, np.arange(pieces + 1))
    ends = [edges]
    for _, _, _, kids in levels[1:]:
        total = np.concatenate([[0], np.cumsum(kids)])
        ends.append(total[ends[-1]])
    out, blobs = [], []
    for p in range(pieces):
        if edges[p] == edges[p + 1]:
            continue
        own = [slice(e[p], e[p + 1]) for e in ends]
        parts = [number[top[1][own[0]]], number[top[1][own[0]] + 1]]
        parts += [number[lv[1][own[i]] + i + 1] for i, lv in enumerate(levels) if i]
        used, renamed = np.unique(np.concatenate(parts), return_inverse=True)
        words = np.split(renamed.astype(np.uint32), np.cumsum([len(x) for x in parts])[:-1])
        sizes = np.array([len(used), *[s.stop - s.start for s in own]], np.int64)
        body = [sizes, names[used], lang[top[1][own[0]]], *words]
        body += [lv[2][own[i]].astype(np.uint32) for i, lv in enumerate(levels)]
        body += [lv[3][own[i - 1]].astype(np.uint32) for i, lv in enumerate(levels) if i]
        out.append(p)
        blobs.append(squeeze(np.array([len(levels)], np.int64).tobytes() + b"".join(b.tobytes() for b in body)))
    yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(blobs, pa.binary())], ["piece", "trie"])


def _read(blob: bytes) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Lang of each first edge; by level, words (the first edge's as two rows), counts, and numbers of children."""
    at = 8
    (depth,) = np.frombuffer(blob, np.int64, 1)

    def take(n: int, kind: type) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, n, at)
        at += out.nbytes
        return out

    sizes = take(int(depth) + 1, np.int64)
    names, lang = take(sizes[0], np.uint64), take(sizes[1], np.uint64)
    first = np.stack([names[take(sizes[1], np.uint32)], names[take(sizes[1], np.uint32)]])
    words = [first, *[names[take(n, np.uint32)] for n in sizes[2:]]]
    counts = [take(n, np.uint32).astype(np.int64) for n in sizes[1:]]
    return lang, words, counts, [take(n, np.uint32).astype(np.int64) for n in sizes[1:-1]]


def merged(blobs: list[bytes], least: int) -> Iterator[dict[str, np.ndarray]]:
    """By level: the frequent nodes of all runs together, with lang, words, count, counts of their left parts and suffix."""
    expand, runs = zstandard.ZstdDecompressor().decompress, []
    for blob in blobs:
        lang, words, counts, kids = _read(expand(blob))
        runs.append([path(path(lang, words[0][0]), words[0][1]), lang, words, counts, kids])
    above: dict[str, np.ndarray] = {}
    level = 0
    while runs:
        key = np.concatenate([r[0] for r in runs])
        count = np.concatenate([r[3][level] for r in runs])
        order = np.argsort(key, kind="stable")  # merges the runs, which are sorted
        sorted_key = key[order]
        first = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1])[: len(order)])
        total = np.add.reduceat(count[order], first) if len(first) else np.zeros(0, np.int64)
        keep = total >= least
        if not keep.any():
            return
        some, one = sorted_key[first[keep]], order[first[keep]]
        last = np.concatenate([r[2][level] if level else r[2][0][1] for r in runs])[one]
        if level == 0:
            lang = np.concatenate([r[1] for r in runs])[one]
            before = np.concatenate([r[2][0][0] for r in runs])[one]
            nodes = {"key": some, "lang": lang, "words": np.stack([before, last], 1), "f": total[keep], "left": np.zeros((len(some), 0), np.int64), "parent": path(lang, before)}
        else:
            up = np.searchsorted(above["key"], np.concatenate([r[5] for r in runs])[one])
            nodes = {"key": some, "lang": above["lang"][up], "words": np.column_stack([above["words"][up], last]), "f": total[keep], "left": np.column_stack([above["left"][up], above["f"][up]]), "parent": above["key"][up]}
        link = nodes["lang"]
        for w in nodes["words"].T[1:]:
            link = path(link, w)
        nodes["suffix"] = link
        yield nodes
        above, on = nodes, []
        for run in runs:
            if level < len(run[4]):
                kids = run[4][level]
                at = np.minimum(np.searchsorted(some, run[0]), len(some) - 1)
                use = np.repeat(some[at] == run[0], kids)
                parent = np.repeat(run[0], kids)[use]
                if len(parent):
                    words, counts, more = list(run[2]), list(run[3]), list(run[4])
                    words[level + 1], counts[level + 1] = words[level + 1][use], counts[level + 1][use]
                    if level + 1 < len(more):  # what hangs below children that go is dropped too
                        below = use
                        for d in range(level + 1, len(more)):
                            deeper = np.repeat(below, more[d])
                            more[d] = more[d][below]
                            words[d + 1], counts[d + 1], below = words[d + 1][deeper], counts[d + 1][deeper], deeper
                    on.append([path(parent, words[level + 1]), run[1], words, counts, more, parent])
        runs, level = on, level + 1


NODES = "key long, lang_key long, words array<long>, f long, lefts array<long>, parent long, suffix long, first long"


def _merge(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for piece, blob in zip(batch.column("piece").to_pylist(), batch.column("trie").to_pylist()):
            held.setdefault(piece, []).append(blob)
    while held:
        for n in merged(held.popitem()[1], least):
            signed = lambda x: pa.array(x.view(np.int64))
            lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.int32()), pa.array(np.ascontiguousarray(m).ravel().view(np.int64), pa.int64()))
            columns = [signed(n["key"]), signed(n["lang"]), lists(n["words"]), pa.array(n["f"]), lists(n["left"]), signed(n["parent"]), signed(n["suffix"]), signed(path(n["lang"], n["words"][:, 0]))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "lang_key", "words", "f", "lefts", "parent", "suffix", "first"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, word = (batch.column(c).to_numpy().view(np.uint64) for c in ("lh", "word"))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(path(lang, word).view(np.int64))], [*batch.schema.names, "key"])


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (l * r)) in decimals of up to 38 digits."""
    d = lambda c: c.cast("decimal(17,0)")
    big = lambda c: c.cast("decimal(38,0)")
    product = big(d(a) * d(n)) * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", big(product), big(d(left) * d(right)))


def collocations(docs: DataFrame, depth: int = 5, least: int = 100, limit: int = 2000) -> DataFrame:
    """(text, lang, ...) -> (lang, rank, phrase, a, l, r, n, score): each lang's first ``limit`` collocations.

    A-Z are lowered; texts are split at . , ; : ! ? and bytes 10-13 into pieces, these at spaces and tabs into words.
    A phrase of 2 to ``depth`` words that occurs at least ``least`` times (overlaps count) within pieces is a candidate;
    its score is the least floor(1000 * a * n / (l * r)) over its cuts in a left and a right part, the first of equal ones.
    Candidates whose words lie in a longer candidate as often as alone go.  Order: score and a descending, phrase
    ascending by its bytes.  A null lang is ``und``; null and empty texts have no words.  Repeated rows count each.
    No candidate, or an empty table: no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = no_clash(docs, "text", "lang").select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_BITS, min(MOST_BITS, (size // BYTES_PER_BUCKET).bit_length()))
    counted = cut(docs.mapInArrow(lambda it: _counts_of_words_and_pairs(it, bits, least), COUNTED_SCHEMA))
    parts = counted.where("part is not null").select("part", "blob").repartition(min(TABLE_PARTS, partitions(spark)), "part")
    mask = np.zeros(1 << bits >> 3, np.uint8)
    for r in parts.mapInArrow(lambda it: _frequent_buckets(it, bits, least), "part int, bits binary").toLocalIterator():  # a bit for each bucket
        part = np.frombuffer(r.bits, np.uint8)
        mask[r.part * len(part) : (r.part + 1) * len(part)] = part
    shared = spark.sparkContext.broadcast(mask)
    words = cut(counted.where("part is null").groupBy("lh", "word").agg(F.first("lang").alias("lang"), F.first("text").alias("text"), F.sum("f").alias("f")))
    release(counted)
    langs = words.groupBy("lh").agg(F.first("lang").alias("lang"), F.sum("f").alias("n"))
    words = words.where(F.col("f") >= least).select("lh", "word", "text", "f").mapInArrow(_keys, "lh long, word long, text string, f long, key long")
    pieces = max(4 * partitions(spark), size // PIECE_BYTES)
    runs = docs.mapInArrow(lambda it: tries(it, depth, pieces, bits, shared.value), "piece long, trie binary")
    nodes = cut(runs.repartition(partitions(spark), "piece").mapInArrow(lambda it: _merge(it, least), NODES))
    shared.unpersist()
    words = cut(words)
    links = nodes.select("key", "f", "suffix").union(words.select("key", "f", F.lit(None).cast("long")))
    links = cut(links.select(F.col("key").alias("link"), F.col("f").alias("r"), F.col("suffix").alias("next")))
    long = nodes.where(F.size("words") > 2)
    inside = long.select(F.col("parent").alias("key"), "f").union(long.select(F.col("suffix").alias("key"), "f")).distinct()
    rows = nodes.join(inside, ["key", "f"], "left_anti")
    rows = rows.join(words.select(F.col("key").alias("first"), F.col("f").alias("one")), "first")
    rows = rows.select("key", "lang_key", "words", "f", F.concat(F.array("one"), "lefts").alias("lefts"), F.col("suffix").alias("link"), F.expr("cast(array() as array<bigint>)").alias("rights"))
    done = None
    for k in range(1, depth):
        rows = rows.join(links, "link").withColumn("rights", F.concat("rights", F.array("r"))).drop("link", "r").withColumnRenamed("next", "link")
        ready = rows.where(F.size("words") == k + 1).drop("link")
        done = ready if done is None else done.union(ready)
        rows = cut(rows.where(F.size("words") > k + 1))
    done = done.join(langs.withColumnRenamed("lh", "lang_key"), "lang_key")
    at = lambda k, c: F.element_at(c, k.cast("int"))
    cuts = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(_score(F.col("f"), F.col("n"), at(k, F.col("lefts")), at(k, F.col("rights"))).alias("score"), k.alias("k")))
    done = done.withColumn("best", F.array_min(cuts)).select("key", "lang_key", "lang", "words", "n", F.col("f").alias("a"), F.col("best.score").alias("score"), at(F.col("best.k"), F.col("lefts")).alias("l"), at(F.col("best.k"), F.col("rights")).alias("r"))
    order = [F.desc("score"), F.desc("a")]
    top = cut(done.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= limit))
    spelt = top.select("key", "lang_key", F.posexplode("words").alias("pos", "word")).join(words.select(F.col("lh").alias("lang_key"), "word", "text"), ["lang_key", "word"])
    spelt = spelt.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("w")).select("key", F.array_join(F.col("w.text"), " ").alias("phrase"))
    out = top.join(spelt, "key").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long"))
    return out.where(F.col("rank") <= limit).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
