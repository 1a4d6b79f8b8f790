"""Exact removal of repeated byte strings by interval expansion on a Burrows-Wheeler transform.

1. Every window of ``length`` bytes selects its least hashed 20-gram (leftmost on ties), so equal windows select the
   same 20-gram at the same offset.  Selected 20-grams are few (about 1 in 41 bytes) and are shuffled, packed, to find
   those that occur more than once; texts that are equal as a whole count once.
2. A repeated 20-gram takes with it the bytes of the windows that selected it.  Equal contexts are combined before and
   after the shuffle; the distinct contexts of one 20-gram meet in one block.  A 20-gram of very many places would make
   too large a block: its windows are dealt one by one, by all their bytes.
3. A block's contexts are concatenated and their suffixes sorted as far as ``length`` bytes.  On the transform, common
   prefixes are derived by increasing value, breadth first: a boundary with common prefix v gives, by one backward
   step, the boundaries with v + 1.  The expansion stops at ``length``; what is then open are the intervals of equal
   windows, and each of their windows but the earliest is a repeat.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, joined_bytes, mix, no_clash, partitions, prefix_hash, slices

GRAM = 20
POSITION_BITS = 31  # of a text that Spark can hold
#: Places of a 20-gram, of texts that differ, beyond which its windows are dealt one by one.
HOT = 2048
EMIT_BYTES = 8 << 20
BLOCK_BYTES = 1 << 20
SENTINEL = 255  # not in UTF-8
PIECES_PER_PARTITION = 4


def _selected(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the gram at each byte; the windows' starts that lie within one text; the gram that each selects."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums, down = prefix_hash(data)
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[:n])
    least = (grams >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | np.arange(n, dtype=np.uint64)
    width, span = 1, length - GRAM + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    room = np.maximum(np.diff(starts) - 1 - length + 1, 0)
    at = np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(room)[:-1]]), room) + np.arange(room.sum())
    return grams, at, (least[at] & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)


def _anchors(batches: Iterator[pa.RecordBatch], length: int, pieces: int) -> Iterator[pa.RecordBatch]:
    """Selected grams as (piece, keys, text hashes, positions), packed by piece."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    small = zstandard.ZstdCompressor(level=1).compress

    def packed() -> pa.RecordBatch:
        keys, texts, places = map(np.concatenate, zip(*held))
        piece = (keys >> np.uint64(32)).astype(np.int64) % pieces
        order = np.argsort(piece, kind="stable")
        ends = np.searchsorted(piece[order], np.arange(pieces + 1))
        cuts = [order[a:b] for a, b in zip(ends[:-1], ends[1:])]
        use = [i for i, c in enumerate(cuts) if len(c)]
        return pa.RecordBatch.from_arrays([pa.array(use, pa.int64()), *[pa.array([small(x[cuts[i]].tobytes()) for i in use], pa.binary()) for x in (keys, texts, places)]], ["piece", "keys", "texts", "places"])

    size = 0
    for batch in slices(batches, "text"):
        data, starts = joined_bytes(batch.column("text"))
        grams, _, chosen = _selected(data, starts, length)
        chosen = np.unique(chosen)
        if len(chosen):
            doc = np.searchsorted(starts, chosen, "right") - 1
            raw = data.tobytes()
            texts = np.zeros(len(starts) - 1, np.uint64)
            for d in np.unique(doc):
                texts[d] = xxhash.xxh64_intdigest(raw[starts[d] : starts[d + 1] - 1], 42)
            held.append((grams[chosen], texts[doc], (chosen - starts[doc]).astype(np.int32)))
        size += len(data)
        if size >= EMIT_BYTES and held:
            yield packed()
            held, size = [], 0
    if held:
        yield packed()
    give_back()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    large = zstandard.ZstdDecompressor().decompress
    by_piece: dict[int, list[tuple[bytes, bytes, bytes]]] = {}
    for batch in batches:
        for piece, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
            by_piece.setdefault(piece, []).append(blobs)
    for blobs in by_piece.values():
        keys, texts, places = (np.concatenate([np.frombuffer(large(b[i]), t) for b in blobs]) for i, t in enumerate((np.uint64, np.uint64, np.int32)))
        order = np.lexsort((places, texts, keys))
        keys, texts, places = keys[order], texts[order], places[order]
        new_key = np.concatenate([[True], keys[1:] != keys[:-1]])
        new = new_key | np.concatenate([[True], (texts[1:] != texts[:-1]) | (places[1:] != places[:-1])])
        keys, texts, places, new_key = keys[new], texts[new], places[new], new_key[new]
        group = np.cumsum(new_key) - 1
        count = np.bincount(group)[group]
        more = count > 1
        if more.any():
            marked = np.where(count > HOT, -1 - places, places)[more]  # below zero: hot
            yield pa.RecordBatch.from_arrays([pa.array(texts[more].view(np.int64)), pa.array(marked.astype(np.int32))], ["text_hash", "place"])
    give_back()


def _starts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[int, int, bytes, list[tuple[int, int, int]]]]:
    """Each text with its contexts of repeated grams: (gram, start, windows), by start."""
    for batch in slices(batches, "text", 1 << 19):
        data, starts = joined_bytes(batch.column("text"))
        wanted, hot = np.zeros(len(data), bool), np.zeros(len(data), bool)
        for base, places in zip(starts, batch.column("places").to_pylist()):
            places = np.array(places)
            wanted[base + np.where(places < 0, -1 - places, places)] = True
            hot[base - 1 - places[places < 0]] = True
        grams, at, chosen = _selected(data, starts, length)
        doc = np.searchsorted(starts, at, "right") - 1
        edge = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])]))
        count = np.diff(np.append(edge, len(at)))
        use = wanted[chosen[edge]]
        edge, count = edge[use], count[use]
        if hot.any():  # a row for each window
            each = np.where(hot[chosen[edge]], count, 1)
            step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            edge, count = np.repeat(edge, each) + step, np.where(np.repeat(each > 1, each), 1, np.repeat(count, each))
        keys, place = grams[chosen[edge]].view(np.int64), at[edge] - starts[doc[edge]]
        one = np.flatnonzero(hot[chosen[edge]])
        ends = np.searchsorted(doc[edge], np.arange(batch.num_rows + 1))
        raw = data.tobytes()
        keys = keys.copy()
        keys[one] = [xxhash.xxh64_intdigest(raw[x : x + length], 7) - (1 << 63) for x in at[edge[one]].tolist()]
        for d, (doc_id, text_hash) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist())):
            own = slice(ends[d], ends[d + 1])
            yield doc_id, text_hash, raw[starts[d] : starts[d + 1] - 1], list(zip(keys[own].tolist(), place[own].tolist(), count[own].tolist()))


_CONTEXT = ["key", "context", "doc_id", "text_hash", "start", "windows"]


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """A row for each context.  Of equal contexts met in one task only the first in order goes on with its bytes; the
    others are repeats already, and their key is no more than a place to go."""
    held: dict[tuple[int, bytes], tuple[int, int, int, int]] = {}
    known: list[tuple[int, int, int, int]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        rows = [(k, c, *place) for (k, c), place in held.items()] + [((p[0] * 31 + p[2]) % (1 << 63), None, *p) for p in known]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], _CONTEXT)
        held.clear()
        known.clear()

    def repeat(place: tuple[int, int, int, int]) -> None:
        if known and known[-1][:2] == place[:2] and sum(known[-1][2:]) == place[2]:  # the next windows of the same text
            doc, text_hash, start, windows = known.pop()
            place = (doc, text_hash, start, windows + place[3])
        known.append(place)

    size = 0
    for doc, text_hash, raw, contexts in _starts(batches, length):
        for key, start, windows in contexts:
            what, place = (key, raw[start : start + windows - 1 + length]), (doc, text_hash, start, windows)
            have = held.get(what)
            if have is None:
                held[what] = place
                size += len(what[1]) + 100
            elif place != have:
                held[what] = min(place, have)
                repeat(max(place, have))
        if size + 100 * len(known) > 32 << 20:
            yield from flush()
            size = 0
    yield from flush()
    give_back()


def sorted_suffixes(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order by at least the first ``depth`` bytes, by doubling from eight."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : n + j]
    known = 8
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        if known >= depth:
            return order
        after = np.zeros(n, np.uint64)
        if known < n:
            after[:-known] = rank[known:] + np.uint64(1)
        key = (rank << np.uint64(32)) | after
        known *= 2


def open_intervals(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in the suffix order, whether its common prefix with the place before is ``length`` or more."""
    n = len(data)
    last = data[order - 1]  # the transform; before the first byte stands the last one
    forward = np.argsort(last, kind="stable")  # forward[b]: the place whose backward step leads to b
    back = np.empty(n, np.int64)
    back[forward] = np.arange(n)
    known = np.zeros(n, bool)
    starts = np.bincount(last, minlength=256)
    frontier = np.unique(np.concatenate([[0], np.cumsum(starts)[:-1]]))
    frontier = frontier[frontier < n]
    known[frontier] = True
    inner = ~known
    inner[0] = False
    gap = np.flatnonzero(inner & (forward != np.concatenate([[0], forward[:-1] + 1])))  # whose preimages are not neighbours
    low, high = forward[gap - 1], forward[gap]
    same = np.concatenate([[False], last[1:] == last[:-1]])
    for _ in range(1, length):
        if not len(frontier):
            break
        step = frontier[same[frontier]]
        reached = back[step]
        if len(gap):
            hit = np.searchsorted(frontier, high, "right") > np.searchsorted(frontier, low, "right")
            reached = np.concatenate([reached, gap[hit]])
            gap, low, high = gap[~hit], low[~hit], high[~hit]
        reached = reached[~known[reached]]
        known[reached] = True
        frontier = np.sort(reached)
    return ~known


def repeated_windows(contexts: list[bytes], windows: np.ndarray, length: int) -> np.ndarray:
    """Contexts in order of precedence -> for each of their windows, in order, whether an earlier window equals it."""
    data = np.frombuffer(bytes([SENTINEL]).join(contexts) + bytes([SENTINEL]), np.uint8)
    order = sorted_suffixes(data, length + 1)
    same = open_intervals(data, order, length)
    base = np.concatenate([[0], np.cumsum([len(c) + 1 for c in contexts])[:-1]])
    at = np.repeat(base - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
    heads = np.flatnonzero(~same)
    first = np.empty(len(data), np.int64)
    first[order] = np.repeat(np.minimum.reduceat(order, heads), np.diff(np.append(heads, len(order))))
    return first[at] != at


def _ranges(flags: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set flags within each context: context, offset, number."""
    ends = np.cumsum(windows)
    context = np.repeat(np.arange(len(windows)), windows)
    edge = np.concatenate([[True], (flags[1:] != flags[:-1]) | (context[1:] != context[:-1])])
    at = np.flatnonzero(edge)
    count = np.diff(np.append(at, len(flags)))
    use = flags[at]
    return context[at][use], (at - (ends - windows)[context[at]])[use], count[use]


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by key -> windows that are repeats."""
    held: dict[tuple[int, bytes], tuple[int, int, int, int]] = {}
    known: list[tuple[int, int, int, int]] = []

    def solved() -> Iterator[pa.RecordBatch]:
        found = [known[:]] if known else []
        # equal windows have the same key and stand at the same place of a context, so that a context alone has none
        several = Counter(key for key, _ in held)
        order = sorted((place, context) for (key, context), place in held.items() if several[key] > 1)
        if order:
            windows = np.array([place[3] for place, _ in order])
            which, offset, count = _ranges(repeated_windows([c for _, c in order], windows, length), windows)
            found.append([(*order[w][0][:2], order[w][0][2] + o, n) for w, o, n in zip(which.tolist(), offset.tolist(), count.tolist())])
        for rows in found:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], _CONTEXT[2:])
        held.clear()
        known.clear()

    size, last = 0, None
    for batch in batches:
        for key, context, *place in zip(*(batch.column(c).to_pylist() for c in _CONTEXT)):
            if size >= BLOCK_BYTES and key != last:
                yield from solved()
                size = 0
            last, place = key, tuple(place)
            have = None if context is None else held.get((key, context))
            if context is None:
                known.append(place)
                size += 40
            elif have is None:
                held[key, context] = place
                size += len(context) + 1
            elif place != have:
                held[key, context] = min(place, have)
                known.append(max(place, have))
    yield from solved()
    give_back()


def _cover(starts: list[int], counts: list[int], n: int, length: int, whole_characters: bytes | None) -> list[tuple[int, int]]:
    """Maximal removed runs; inside them, with ``whole_characters``, only whole UTF-8 characters."""
    runs: list[list[int]] = []
    for a, c in sorted(zip(starts, counts)):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], a + c - 1 + length)
        else:
            runs.append([a, a + c - 1 + length])
    if whole_characters is not None:
        for r in runs:
            while r[0] < r[1] and whole_characters[r[0]] & 0xC0 == 0x80:
                r[0] += 1
            while r[0] < r[1] < n and whole_characters[r[1]] & 0xC0 == 0x80:
                r[1] -= 1
    return [(a, b) for a, b in runs if a < b]


def _results(batches: Iterator[pa.RecordBatch], length: int, as_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 4 << 20):
        out = []
        for text, copy, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "is_copy", "spans"))):
            raw = text.encode()
            if copy:
                runs = [(0, len(raw))] if len(raw) >= length else []
            else:
                runs = _cover([s["start"] for s in spans or ()], [s["windows"] for s in spans or ()], len(raw), length, raw if as_text else None)
            kept, at = [], 0
            for a, b in runs:
                kept.append(raw[at:a])
                at = b
            rest = b"".join(kept) + raw[at:]
            out.append((len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(rest).hexdigest(), rest.decode() if as_text else None))
        n, removed, runs, digest, kept = zip(*out)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest), pa.array(kept, pa.string())],
            ["doc_id", "text_hash", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
        )
    give_back()


def remove_repeats(docs: DataFrame, length: int = 100, as_text: bool = False) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, text_hash, n_bytes, n_removed, n_spans, kept_sha256, kept_text), a row for each row.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a row of smaller doc_id, or
    earlier in the same text; strings are judged on the input.  With ``as_text``, kept_text has what is left, and
    characters of several bytes go only as a whole.  Null texts count as empty; rows without doc_id are left out.  Rows
    that repeat a doc_id with the same text are one document and each get its result; different texts under one doc_id
    are taken in the order of their hashes (text_hash, Spark's xxhash64).  Other columns are ignored.
    """
    n = partitions(docs.sparkSession)
    pieces = n * PIECES_PER_PARTITION
    docs = no_clash(docs, "doc_id", "text").where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = (
        docs.select("text").mapInArrow(lambda it: _anchors(it, length, pieces), "piece long, keys binary, texts binary, places binary")
        .repartition(n, "piece").mapInArrow(_repeated, "text_hash long, place int")
        .groupBy("text_hash").agg(F.collect_list("place").alias("places"))
    )
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    ids = base.select("doc_id", "text_hash", F.md5("text").alias("digest"))
    firsts = ids.groupBy("digest", "text_hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    wanted = cut(firsts.join(found, "text_hash").select(F.col("least").alias("doc_id"), "text_hash", "places").dropDuplicates(["doc_id", "text_hash"]))
    spans = (
        base.join(wanted, ["doc_id", "text_hash"], "left").where("places is not null").select("doc_id", "text_hash", "text", "places")
        .mapInArrow(lambda it: _contexts(it, length), "key long, context binary, doc_id long, text_hash long, start int, windows int")
        .repartition(n, "key").sortWithinPartitions("key").mapInArrow(lambda it: _blocks(it, length), "doc_id long, text_hash long, start int, windows int")
        .groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    )
    copied = ids.join(firsts.where("least < most"), ["digest", "text_hash"]).where("doc_id > least").select("doc_id", "text_hash").distinct()
    gone = spans.withColumn("is_copy", F.lit(False)).unionByName(copied.withColumn("is_copy", F.lit(True)), allowMissingColumns=True)
    return (
        base.join(gone, ["doc_id", "text_hash"], "left").select("doc_id", "text_hash", "text", F.coalesce("is_copy", F.lit(False)).alias("is_copy"), "spans")
        .mapInArrow(lambda it: _results(it, length, as_text), "doc_id long, text_hash long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    )
