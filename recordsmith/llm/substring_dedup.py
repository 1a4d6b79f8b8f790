"""Near-duplicate passages by compact windows (after Deng, Wang et al., SIGMOD 2022, on text alignment).

A text is the sequence of its word shingles.  Under one hash function, all subsequences whose least hash stands at the
same place form a compact window: a node of the sequence's Cartesian tree, from behind the nearest smaller hash on its
left to before the nearest on its right.  Nodes that span less than a passage are left out, which leaves about two for
each passage length, a word count that does not grow with the text's repetitions.

The windows of two hash functions are joined as intervals: where both hold the same subsequences of a passage's length,
their two least hashes are one signature of these.  Several pairs of functions give as many chances.  Under each
signature, windows whose subsequences are the same shingles throughout are one class: each is set against the first of
its class, and the classes against two pivots among them, that of most documents and that of the earliest one.  After these
are compared, different classes are set against each other where the later window's place is in no passage that repeats
an earlier one yet, or the two documents are not linked yet, directly or through others.  So families of edited copies
cost a multiple of their number, apart from windows that are similar to no pivot: these still meet all others.  Many equal windows of
one task are salted, and only the first of them stands for them under the signature itself.

Where both hashes of a signature are of common shingles, as a sketch of all texts counts them, what so many texts share
may be a line only, and their pairs would grow with the square of its texts.  Similar subsequences there share a shingle
that is not common, and meet under it, one of the first few of each; or they have few of these: such windows are of one
class where their common shingles are the same.  So similar windows that share a signature stay linked, some of them
through others; a passage that was found by windows which are not similar themselves may be missed.

Signatures that two texts share are put together along their
diagonals to candidate passages, whose shingle sets are compared.  Texts that are equal as a whole are one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, joined_bytes, mix, no_clash, partitions, release, shingles, slices, words
from .graph import components
from .packed import PIECES_PER_PARTITION, Packer, deal, unpacked

SHINGLE, PASSAGE_WORDS, PERCENT = 5, 50, 80
#: Pairs of hash functions; both functions of one pair must collide on a passage.
PAIRS = 3
#: Windows of one class in one task, beyond which they are salted; rows that a task looks at together.
HOT, ROWS = 64, 1 << 20
#: Odd multiplier of the hashes of sequences, and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
#: Counters of shingles; a shingle is common if it comes so much oftener than the counters' mean and its usual deviations.
SKETCH_BITS, COMMON = 23, 32
#: Pieces of the counters; shingles that a task counts at a time.
SKETCH_PIECES, COUNTED = 64, 1 << 22
#: Windows whose shingles are sorted at a time.
STEP_WINDOWS = 1 << 15
#: Shingles of the candidates that meet one copy of the earlier text; more candidates take more copies of it.
PART_SHINGLES = 50_000
#: Shingles that are compared at a time.
STEP_SHINGLES = 1 << 20


def compact_windows(values: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, place, last) of the Cartesian tree's nodes that span ``least`` values or more, in each text, by place.

    Of equal values the left one is the smaller.
    """
    n = len(values)
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    bits = np.uint64(n.bit_length())
    ranked = (values >> bits << bits) | np.arange(n, dtype=np.uint64)
    lowest, width = ranked, 1
    while 2 * width <= least:
        lowest = np.minimum(lowest[:-width], lowest[width:])
        width *= 2
    if width < least:
        lowest = np.minimum(lowest[: len(lowest) - (least - width)], lowest[least - width :])
    room = np.maximum(np.diff(bounds) - least + 1, 0)
    at = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(room)[:-1]]), room) + np.arange(room.sum())
    at = (lowest[at] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)  # in order of places
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    # a node's nearest smaller values span more than the node does, so that they are among these places
    low, doc = ranked[at], np.searchsorted(bounds, at, "right") - 1
    begin, end = np.searchsorted(at, bounds[doc]), np.searchsorted(at, bounds[doc + 1])
    levels = [low]
    while (2 << (len(levels) - 1)) <= (np.max(end - begin) if len(at) else 0):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    left = right = np.arange(len(at))
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        more = np.maximum(left - step, 0)
        left = np.where((left - step >= begin) & (levels[k][np.minimum(more, len(levels[k]) - 1)] > low), more, left)
        right = np.where((right + step < end) & (levels[k][np.minimum(right + 1, len(levels[k]) - 1)] > low), right + step, right)
    first = np.where(left > begin, at[np.maximum(left - 1, 0)] + 1, bounds[doc])
    last = np.where(right + 1 < end, at[np.minimum(right + 1, len(at) - 1)] - 1 if len(at) else at, bounds[doc + 1] - 1)
    return first, at, last


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


def sequence_hash(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums S and inverse powers R: the hash of grams[a:b] is (S[b] - S[a]) * R[a], modulo 2 ** 64."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams * _powers(BASE, len(grams))[:-1], dtype=np.uint64)]), _powers(BACK, len(grams))


def signatures(grams: np.ndarray, bounds: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(signature, places of the two least hashes, hash of all shingles of the subsequences, their first start, their end)
    of all subsequences of ``least`` shingles, for each pair of functions: the windows of both, as intervals of the
    subsequences' starts, are joined where they overlap."""
    sums, back = sequence_hash(grams)
    for pair in range(PAIRS):
        begins, hashes, places = [], [], []
        for function in (2 * pair, 2 * pair + 1):
            values = mix(grams ^ np.uint64(0x9E3779B97F4A7C15 * (function + 1) % (1 << 64)))
            first, at, _ = compact_windows(values, bounds, least)
            begins.append(np.maximum(first, at - least + 1))
            hashes.append(values[at])
            places.append(at)
        starts = np.union1d(*begins)
        one, two = (np.searchsorted(b, starts, "right") - 1 for b in begins)
        if len(starts):
            # the subsequences start before the next ones do, and end in their text
            stop = np.minimum(np.append(starts[1:], len(grams)) - 1 + least, bounds[np.searchsorted(bounds, starts, "right")])
            content = mix((sums[stop] - sums[starts]) * back[starts] + (stop - starts).astype(np.uint64))
            yield mix(hashes[0][one] * np.uint64(0xD6E8FEB86659FD93) + hashes[1][two] + np.uint64(pair)), places[0][one], places[1][two], content, starts, stop


def _highest(values: np.ndarray, length: int) -> np.ndarray:
    """The highest of each value and the ``length`` - 1 before it."""
    out, width = values.copy(), 1
    while width < length:
        step = min(width, length - width)
        out[step:] = np.maximum(out[step:], out[:-step].copy())
        width += step
    return out


def keyed(grams: np.ndarray, bounds: np.ndarray, least: int, percent: int, common: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, place, content) of the windows: signatures; of those whose hashes are both of common shingles, only the windows
    with so few other shingles that similar ones may share none, by their common ones; and the first other shingles of all
    their subsequences, in the order of hashes, as many as one subsequence can have without a similar one and one more."""
    few = least * (100 - percent) // 100
    other = np.concatenate([[0], np.cumsum(~common)])
    alike = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(common, mix(grams), np.uint64(0)), dtype=np.uint64)])
    hot_starts = np.zeros(len(grams) + 1, bool)
    for key, place, place_two, content, starts, stop in signatures(grams, bounds, least):
        hot = common[place] & common[place_two]
        yield key[~hot], place[~hot], content[~hot]
        if hot.any():
            count = stop[hot] - least + 1 - starts[hot]
            at, whose = _ranges(starts[hot], starts[hot] + count)
            hot_starts[at] = True
            others = other[at + least] - other[at]
            # of a window's subsequences those with the fewest others are one row, by all from the first of them to the last
            lots = np.cumsum(count) - count
            best = np.minimum.reduceat(others << 40 | at, lots)
            least_others, first = best >> 40, best & ((1 << 40) - 1)
            last = np.maximum.reduceat(np.where(others == least_others[whose], at, 0), lots)
            light = (others <= few) & ((others > least_others[whose]) | (at == first[whose]))
            at, whose = at[light], whose[light]
            end = np.where(at == first[whose], last[whose], at)
            yield key[hot][whose], place[hot][whose], mix(alike[end + least] - alike[at] + (end - at).astype(np.uint64) * np.uint64(BASE))
    begin = np.flatnonzero(hot_starts)
    begin = begin[other[begin + least] > other[begin]] if len(begin) else begin
    if len(begin):
        none = np.uint64((1 << 64) - 1)
        order = np.where(common, none, mix(grams ^ np.uint64(BASE)))
        bound, windows = np.zeros(len(grams), np.uint64), np.lib.stride_tricks.sliding_window_view(order, least)
        for i in range(0, len(begin), STEP_WINDOWS):
            own = begin[i : i + STEP_WINDOWS]
            bound[own] = np.partition(windows[own], few, axis=1)[:, few]
        at = np.flatnonzero(~common & (order <= _highest(bound, least)))
        doc = np.searchsorted(bounds, at, "right") - 1
        low, high = np.maximum(at - least + 1, bounds[doc]), np.minimum(at + least, bounds[doc + 1])
        sums, back = sequence_hash(grams)
        yield mix(order[at]), at, mix((sums[high] - sums[low]) * back[low] + (high - low + (at - low << 32)).astype(np.uint64))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, held, small = np.zeros(1 << SKETCH_BITS, np.int32), [], zstandard.ZstdCompressor(level=1).compress

    def add() -> None:
        if held:
            np.add(counts, np.bincount(np.concatenate(held), minlength=len(counts)), out=counts, casting="unsafe")
        held.clear()

    for batch in slices(batches, "text"):
        held.append((_grams(batch.column("text"))[0] >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
        if sum(map(len, held)) > COUNTED:
            add()
    add()
    if counts.any():
        pieces = [small(x.tobytes()) for x in np.split(counts, SKETCH_PIECES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PIECES), pa.int64()), pa.array(pieces, pa.binary())], ["piece", "counts"])
    give_back()


def _common_of(batches: Iterator[pa.RecordBatch], above: int) -> Iterator[pa.RecordBatch]:
    total, large = {}, zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for piece, counts in zip(*(c.to_pylist() for c in batch.columns)):
            total[piece] = total.get(piece, 0) + np.frombuffer(large(counts), np.int32).astype(np.int64)
    for piece, counts in total.items():
        mean = counts.mean()
        bits = np.packbits(counts > mean + 6 * np.sqrt(mean) + above)
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([bits.tobytes()], pa.binary())], ["piece", "bits"])


def common_shingles(docs: DataFrame, above: int) -> np.ndarray:
    """A bit for each of 2 ** SKETCH_BITS classes of shingles, by their highest bits: whether it comes often (1 MB, whatever the input)."""
    parts = docs.mapInArrow(_counted, "piece long, counts binary").repartition(min(SKETCH_PIECES, partitions(docs.sparkSession)), "piece")
    out = np.zeros((SKETCH_PIECES, (1 << SKETCH_BITS) // SKETCH_PIECES // 8), np.uint8)
    for r in cut(parts.mapInArrow(lambda it: _common_of(it, above), "piece long, bits binary")).collect():
        out[r.piece] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, starts = joined_bytes(column)
    hashes, _, _, bounds = words(data, starts, True)
    return shingles(hashes, bounds, SHINGLE)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, words) of each text."""
    for batch in slices(batches, "text"):
        data, starts = joined_bytes(batch.column("text"))
        n = np.diff(words(data, starts, True)[3])
        digest = pa.array([hashlib.md5((t or "").encode()).digest() for t in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), digest, pa.array(n, pa.int32())], ["doc_id", "digest", "n"])


def _of_copies(key: np.ndarray, name: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows of the first of equal texts, under each key."""
    order = np.lexsort((doc, name, key))
    key, name, doc = key[order], name[order], doc[order]
    begin = np.concatenate([[True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])])
    return order[doc == doc[np.maximum.accumulate(np.where(begin, np.arange(len(key)), 0))]]


def _salted(key: np.ndarray, doc: np.ndarray, name: np.ndarray, place: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of a class that many rows here have, under a key of their own; the first document's stand under both."""
    order = np.lexsort((place, doc, content, key))
    key, doc, name, place, content = (x[order] for x in (key, doc, name, place, content))
    begin = np.flatnonzero(_groups(key, content))
    count = np.diff(np.append(begin, len(key)))
    hot = np.repeat(count > HOT, count)
    first = hot & (doc == np.repeat(doc[begin], count))
    own = np.where(hot, mix(key ^ mix(content + np.uint64(doc.min() & 0xFFFFFFFF) + np.uint64(len(doc)))), key)
    return tuple(np.concatenate(x) for x in ((own, key[first]), (doc, doc[first]), (name, name[first]), (place, place[first]), (content, content[first])))


def _sent(batches: Iterator[pa.RecordBatch], pieces: int, passage: int, percent: int, often: np.ndarray) -> Iterator[pa.RecordBatch]:
    packer, least = Packer(pieces, 5), passage - SHINGLE + 1
    held: list[tuple[np.ndarray, ...]] = []
    often = np.unpackbits(often).astype(bool)

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            key, doc, name, place, content = map(np.concatenate, zip(*held))
            keep = _of_copies(key, name, doc)
            rows = _salted(*(x[keep] for x in (key, doc, name, place, content)))
            yield from packer.add((rows[0] >> np.uint64(32)).astype(np.int64) % pieces, *rows)
            yield from packer.flush()
        held.clear()

    for batch in slices(batches, "text"):
        grams, bounds = _grams(batch.column("text"))
        names = np.array([xxhash.xxh64_intdigest((t or "").encode(), 42) for t in batch.column("text").to_pylist()], np.uint64)
        ids = batch.column("doc_id").to_numpy()
        for key, place, content in keyed(grams, bounds, least, percent, often[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]):
            doc = np.searchsorted(bounds, place, "right") - 1
            held.append((key, ids[doc], names[doc], (place - bounds[doc]).astype(np.int32), content))
        if sum(len(h[0]) for h in held) > ROWS:
            yield from flush()
    yield from flush()


def pairs_of_classes(key: np.ndarray, doc: np.ndarray, content: np.ndarray, covered: np.ndarray | None = None, group: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows, sorted by key, content, document and place, to be set against each other under a key, as (later, earlier).

    All rows of a class against the first document's first row; all rows of the first documents of classes against the
    first rows of the other classes of earlier documents.  Where one document is the first of two classes, the next
    document of one of them stands for it.  Where it is known which rows are covered and to which group each one's document
    belongs, only pairs of different classes are given of which the later row is not covered or the groups differ.
    """
    n = np.arange(len(key))
    begin, head, second, lead, low, high = _classes(key, doc, content)
    if covered is None:
        yield n[doc != doc[head]], head[doc != doc[head]]
    wide, need = high - low > 1, np.ones(len(begin), bool)
    if covered is not None and len(key):
        lots = np.flatnonzero(_groups(key))
        mixed = np.minimum.reduceat(group, lots) != np.maximum.reduceat(group, lots)
        need = np.logical_or.reduceat(~covered, begin) | mixed[np.searchsorted(lots, begin, "right") - 1]

    def apart(later: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if covered is None:
            return later, earlier
        use = ~covered[later] | (group[later] != group[earlier])
        return later[use], earlier[use]

    wide = np.flatnonzero(wide & need)
    at, sums = 0, np.concatenate([[0], np.cumsum(high[wide] - low[wide])])
    while at < len(wide):  # about a million pairs of classes at a time
        upto = max(at + 1, int(np.searchsorted(sums, sums[at] + ROWS, "right")) - 1)
        own = wide[at:upto]
        theirs, whose = _ranges(low[own], high[own])
        mine = own[whose]
        x, y = doc[begin[mine]], doc[begin[theirs]]
        use = x > y
        rows, which = _ranges(begin[mine[use]], lead[mine[use]])
        yield apart(rows, begin[theirs[use]][which])
        same = (x == y) & ((mine < theirs) | ~need[theirs]) & (mine != theirs)
        mine, theirs = mine[same], theirs[same]
        use = second[theirs] >= 0
        a, b = np.where(use, second[theirs], second[mine]), np.where(use, begin[mine], begin[theirs])
        yield apart(a[a >= 0], b[a >= 0])
        at = upto


def _classes(key: np.ndarray, doc: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of sorted rows: where each class begins; each row's class's first row; of each class the first row of its second
    document, or -1, and the row behind its first document's; and the first and last (before) class under the same key."""
    n = np.arange(len(key))
    new = _groups(key, content)
    begin = np.flatnonzero(new)
    head = np.maximum.accumulate(np.where(new, n, 0))
    cls = np.cumsum(new) - 1
    other = np.flatnonzero(doc != doc[head])
    second = np.full(len(begin), -1)
    second[cls[other[::-1]]] = other[::-1]
    lead = np.where(second >= 0, second, np.append(begin[1:], len(key)))
    lots = np.flatnonzero(_groups(key[begin]))
    which = np.searchsorted(lots, np.arange(len(begin)), "right") - 1
    return begin, head, second, lead, lots[which], np.append(lots[1:], len(begin))[which]


def pairs_with_pivots(key: np.ndarray, doc: np.ndarray, content: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As pairs_of_classes, but the classes under a key are set against two of them only: that of most documents, of which
    most others are edited copies, and that of the earliest document."""
    n = np.arange(len(key))
    begin, head, second, lead, low, _ = _classes(key, doc, content)
    yield n[doc != doc[head]], head[doc != doc[head]]
    if not len(key):
        return
    first, size = doc[begin], np.add.reduceat(_groups(key, content, doc).astype(np.int64), begin)
    lots = np.unique(low)
    pivots = [order[lots] for order in (np.lexsort((first, -size, low)), np.lexsort((first, low)))]
    which = np.searchsorted(lots, low)
    for i, pivot in enumerate(pivots):
        theirs = pivot[which]
        mine = np.flatnonzero((theirs != np.arange(len(begin))) & ((pivots[0][which] != theirs) | (i == 0)))
        theirs = theirs[mine]
        different = first[mine] != first[theirs]
        rows, whose = _ranges(begin[mine[different]], lead[mine[different]])
        others = begin[theirs[different]][whose]
        # the earlier of two documents stands with its first row
        later = doc[rows] > doc[others]
        yield rows[later], others[later]
        c, d = mine[different], theirs[different]
        swap = first[c] < first[d]
        rows, whose = _ranges(begin[d[swap]], lead[d[swap]])
        yield rows, begin[c[swap]][whose]
        c, d = mine[~different], theirs[~different]
        use = second[d] >= 0
        a, b = np.where(use, second[d], second[c]), np.where(use, begin[c], begin[d])
        yield a[a >= 0], b[a >= 0]


def _met(pairs: Iterator[tuple[np.ndarray, np.ndarray]], doc: np.ndarray, place: np.ndarray, packer: Packer) -> Iterator[pa.RecordBatch]:
    """(a, b, place in a, place in b) of windows that are set against each other, packed by the pair of texts; a stands after b."""
    for later, earlier in pairs:
        a, b = doc[later], doc[earlier]
        piece = (mix(a.view(np.uint64) * np.uint64(31) + b.view(np.uint64)) % np.uint64(packer.pieces)).astype(np.int64)
        yield from packer.add(piece, a, b, place[later], place[earlier])


def _with_kind(batches: Iterator[pa.RecordBatch], kind: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, kind, np.int32)), *batch.columns], ["kind", *batch.schema.names])


def _collisions(batches: Iterator[pa.RecordBatch], pieces: int) -> Iterator[pa.RecordBatch]:
    """Of windows that share a signature, kind 0: those that are set against a pivot, packed by the pair of texts; kind 1: of
    keys with several classes those that may be set against each other later, as (key, content, document, place)."""
    met, left = Packer(pieces, 4), Packer(pieces, 4)
    for key, doc, name, place, content in unpacked(batches, [np.uint64, np.int64, np.uint64, np.int32, np.uint64]):
        keep = _of_copies(key, name, doc)
        order = keep[np.lexsort((place[keep], doc[keep], content[keep], key[keep]))]
        key, doc, place, content = key[order], doc[order], place[order], content[order]
        yield from _with_kind(_met(pairs_with_pivots(key, doc, content), doc, place, met), 0)
        begin, _, second, lead, low, high = _classes(key, doc, content)
        wide = high - low > 2
        rows = np.concatenate([_ranges(begin[wide], lead[wide])[0], second[wide & (second >= 0)]])
        piece = (mix(doc[rows].view(np.uint64)) % np.uint64(pieces)).astype(np.int64)
        yield from _with_kind(left.add(piece, key[rows], content[rows], doc[rows], place[rows]), 1)
    yield from _with_kind(met.flush(), 0)
    yield from _with_kind(left.flush(), 1)


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for columns in unpacked(batches, [np.int64, np.int64, np.int64, np.int32]):
        for i in range(0, len(columns[0]), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + ROWS]) for c in columns], ["key", "content", "doc", "place"])


_TAGGED = {"key": np.int64, "content": np.int64, "doc": np.int64, "place": np.int32, "covered": np.int8, "grp": np.int64}


def _tagged(batches: Iterator[pa.RecordBatch], pieces: int) -> Iterator[pa.RecordBatch]:
    packer = Packer(pieces, len(_TAGGED))
    for batch in batches:
        columns = [batch.column(c).to_numpy().astype(t) for c, t in _TAGGED.items()]
        yield from packer.add((columns[0].view(np.uint64) >> np.uint64(32)).astype(np.int64) % pieces, *columns)
    yield from packer.flush()


def _apart(batches: Iterator[pa.RecordBatch], pieces: int) -> Iterator[pa.RecordBatch]:
    packer = Packer(pieces, 4)
    for columns in unpacked(batches, list(_TAGGED.values())):
        order = np.lexsort([columns[i] for i in (3, 2, 1, 0)])
        key, content, doc, place, covered, group = (c[order] for c in columns)
        yield from _met(pairs_of_classes(key, doc, content, covered.astype(bool), group), doc, place, packer)
    yield from packer.flush()


def _groups(*breaks: np.ndarray) -> np.ndarray:
    """Where groups of sorted rows begin: at the first row and wherever a column changes or, of booleans, is set."""
    out = np.zeros(len(breaks[0]), bool)
    out[:1] = True
    for column in breaks:
        out |= column if column.dtype == bool else np.concatenate([[True], column[1:] != column[:-1]])
    return out


def candidates(a: np.ndarray, b: np.ndarray, at: np.ndarray, to: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Shared places of two texts -> (a, b, a_first, a_end, b_first, b_end): places of neighbouring diagonals no farther
    apart than three passages, with a margin of a passage and a half."""
    gap = lambda x, most: np.concatenate([[True], np.abs(np.diff(x)) > most])
    diagonal = at.astype(np.int64) - to
    order = np.lexsort((at, diagonal, b, a))
    a, b, at, to, diagonal = (x[order] for x in (a, b, at, to, diagonal))
    band = np.cumsum(_groups(a, b, gap(diagonal, least)))
    order = np.lexsort((at, band))
    a, b, at, to, band = (x[order] for x in (a, b, at, to, band))
    begin = np.flatnonzero(_groups(band, gap(at, 3 * least)))
    margin = least + least // 2
    low, high = (lambda x: np.minimum.reduceat(x, begin) - margin), (lambda x: np.maximum.reduceat(x, begin) + margin + 1)
    return a[begin], b[begin], np.maximum(low(at), 0), high(at), np.maximum(low(to), 0), high(to)


_FOUND = ["a", "b", "a_first", "a_end", "b_first", "b_end"]


def _candidates(batches: Iterator[pa.RecordBatch], passage: int) -> Iterator[pa.RecordBatch]:
    for rows in unpacked(batches, [np.int64, np.int64, np.int32, np.int32]):
        found = candidates(*rows, passage - SHINGLE + 1)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if i < 2 else pa.int32()) for i, x in enumerate(found)], _FOUND)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Rows of a column of lists of structs: whose each is, and its fields."""
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False)), dict(zip([f.name for f in flat.type], flat.flatten()))


def _cut_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each candidate with the shingles of its passage in the first text, as numbers of 32 bits."""
    for batch in slices(batches, "text"):
        grams, bounds = _grams(batch.column("text"))
        short, (row, found) = (grams >> np.uint64(32)).astype(np.uint32), _flat(batch.column("found"))
        low = np.minimum(bounds[row] + found["a_first"].to_numpy(), bounds[row + 1])
        high = np.minimum(bounds[row] + found["a_end"].to_numpy(), bounds[row + 1])
        own = pa.array([short[x:y].tobytes() for x, y in zip(low.tolist(), high.tolist())], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(row)), *[found[c] for c in ("b", "part", "a_first", "b_first", "b_end")], own], ["a", "b", "part", "a_first", "b_first", "b_end", "grams"])


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    one, two = set(x.tolist()), set(y.tolist())
    return len(one & two) / len(one | two)


def _before(values: np.ndarray) -> np.ndarray:
    """Place of the same value's occurrence before, or -1."""
    order = np.argsort(values, kind="stable")
    out = np.full(len(values), -1)
    same = values[order[1:]] == values[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _distinct(before: np.ndarray, which: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each of these lengths and each window of it, by its start, how many different values it has, of those at the places
    ``which``; windows that go beyond the end have no meaning."""
    n, m = len(before) + 1, len(lengths)
    left = np.maximum(before[which], which - lengths[:, None]) + 1 + np.arange(m)[:, None] * n
    change = np.bincount(left.ravel(), minlength=n * m).reshape(m, n)
    change[:, which + 1] -= 1
    return np.cumsum(change, axis=1)


def best_partner(own: np.ndarray, theirs: np.ndarray, before: np.ndarray, least: int, percent: int, every: dict[int, np.ndarray]) -> tuple[int, int, int]:
    """(first, end, surplus) of the partner's part most similar to a stretch, of all places and of some lengths; they are
    similar if the surplus, (100 + percent) * shared - percent * (different shingles of both), is not below zero.  Shingles are small numbers here; ``every`` keeps
    the partner's counts of different shingles by length."""
    has = np.zeros(int(max(own.max(), theirs.max())) + 1, bool)
    has[own] = True
    shared, size = np.flatnonzero(has[theirs]), int(has.sum())
    lengths = sorted({x for x in (min(max(least, round(size * x / 100)), len(theirs)) for x in (100, 90, 110, percent, 10_000 / percent)) if x >= least})
    best = (0, 0, -(1 << 62))
    if not lengths:
        return best
    if more := [x for x in lengths if x not in every]:
        every |= zip(more, _distinct(before, np.arange(len(theirs)), np.array(more)))
    for length, both in zip(lengths, _distinct(before, shared, np.array(lengths))):
        upto = len(theirs) - length + 1
        surplus = (100 + percent) * both[:upto] - percent * every[length][:upto]
        k = int(surplus.argmax())
        if (most := int(surplus[k]) - percent * size) > best[2]:
            best = (k, k + length, most)
    return best


def similar_passages(mine: np.ndarray, theirs: np.ndarray, least: int, percent: int) -> Iterator[tuple[int, int, int, int, float]]:
    """Similar parts (first, end, partner first, partner end, Jaccard) of a candidate's shingles: the whole of it, else the
    stretches whose every window of ``least`` shingles shares enough, else the best window of such a stretch.  Where the
    first places of the outermost shared shingles do not align the two, the stretch is set against all places of the
    partner, and then its windows are, each grown as far as it stays similar."""
    numbers = mine.tolist()
    # first places in the partner
    place = dict(zip(theirs[::-1].tolist(), range(len(theirs) - 1, -1, -1)))
    hit = np.fromiter(map(place.__contains__, numbers), bool, len(numbers))
    shared = np.flatnonzero(hit)
    if len(shared) < 2:
        return

    def enough(a: int, b: int) -> bool:
        """Whether the stretch has so few shingles that the partner lacks that it can be similar to any part of it."""
        different = set(numbers[a:b])
        return 100 * len(different & place.keys()) >= percent * len(different)

    def tried(a: int, b: int) -> tuple[int, int, int, int, float] | None:
        own = shared[np.searchsorted(shared, a) : np.searchsorted(shared, b)]
        if not len(own) or not enough(a, b):
            return None
        k = max(place[int(mine[own[0]])] - int(own[0] - a), 0)
        m = min(place[int(mine[own[-1]])] + int(b - own[-1]), len(theirs))
        if m - k < least or b - a < least:
            return None
        similar = _jaccard(mine[a:b], theirs[k:m])
        return (a, b, k, m, similar) if 100 * similar >= percent else None

    whole = tried(int(shared[0]), int(shared[-1]) + 1)
    if whole:
        yield whole
        return
    total = np.concatenate([[0], np.cumsum(hit)])
    inside = total[least:] - total[:-least]
    starts = np.flatnonzero(inside >= -(-least * 2 * percent // (100 + percent)))
    if not len(starts):
        return
    number = np.unique(np.concatenate([mine, theirs]), return_inverse=True)[1]
    own_number, their_number, every = number[: len(mine)], number[len(mine) :], {}
    before = _before(their_number)

    def placed(a: int, b: int) -> tuple[int, int, int, int, float] | None:
        if not enough(a, b):
            return None
        k, m, surplus = best_partner(own_number[a:b], their_number, before, least, percent, every)
        return (a, b, k, m, _jaccard(mine[a:b], theirs[k:m])) if surplus >= 0 else None

    for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1) if len(starts) else ():
        best = int(run[np.argmax(inside[run])])
        a, end = int(run[0]), int(run[-1]) + least
        found = tried(a, end) or placed(a, end)
        if found:
            yield found
            continue
        while a + least <= end:
            different = set(numbers[a : a + least])
            surplus = 100 * len(different & place.keys()) - percent * len(different)  # at most
            if surplus >= 0:
                surplus = best_partner(own_number[a : a + least], their_number, before, least, percent, every)[2]
            if surplus < 0:  # a window one on gains a shared shingle, for one that is not, at most
                a += -(surplus // (100 + percent))
                continue
            low, high = a + least, end
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if placed(a, middle) else (low, middle - 1)
            found = placed(a, low)
            # what the partner's part does not have at the end may belong to the next passage
            low = max(a + least, a + 1 + int(np.flatnonzero(np.isin(mine[a:low], theirs[found[2] : found[3]]))[-1]))
            yield (a, low, *found[2:4], _jaccard(mine[a:low], theirs[found[2] : found[3]]))
            a = low
        if not found and (found := tried(best, best + least)):
            yield found


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from low to before high, range after range, and whose each is."""
    count = np.maximum(high - low, 0)
    whose = np.repeat(np.arange(len(low)), count)
    return np.arange(count.sum()) + (low - np.cumsum(count) + count)[whose], whose


def compared(mine: np.ndarray, my_bounds: np.ndarray, theirs: np.ndarray, their_bounds: np.ndarray, least: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates side by side -> similar wholes as rows (candidate, first, end, partner first, partner end, shared,
    different shingles of both), from the first shared shingle to the last on either side; and the candidates that are not
    similar as wholes but have some ``least`` shingles of which enough are shared."""
    n = len(my_bounds) - 1
    sides = []
    for values, bounds in ((mine, my_bounds), (theirs, their_bounds)):
        whose = np.repeat(np.arange(n), np.diff(bounds))
        sides.append((whose.astype(np.uint64) << np.uint64(32) | values, whose, bounds))
    shared, trimmed = [], []
    for (key, whose, bounds), (other, _, _) in (sides, sides[::-1]):
        hit = np.isin(key, other)
        at = np.flatnonzero(hit)
        low, high = np.searchsorted(whose[at], np.arange(n)), np.searchsorted(whose[at], np.arange(n), "right")
        some = high > low
        first = np.where(some, at[np.minimum(low, len(at) - 1)] if len(at) else 0, bounds[:-1])
        end = np.where(some, at[high - 1] + 1 if len(at) else 0, bounds[:-1])
        shared.append(hit)
        trimmed.append((first, end))
    distinct = []
    for (key, _, _), (first, end) in zip(sides, trimmed):
        distinct.append(np.unique(key[_ranges(first, end)[0]]))
    size = [np.bincount((d >> np.uint64(32)).astype(np.int64), minlength=n) for d in distinct]
    both = np.bincount((np.intersect1d(*distinct, assume_unique=True) >> np.uint64(32)).astype(np.int64), minlength=n)
    union = size[0] + size[1] - both
    fits = (100 * both >= percent * union) & (trimmed[0][1] - trimmed[0][0] >= least) & (trimmed[1][1] - trimmed[1][0] >= least) & (union > 0)
    k = np.flatnonzero(fits)
    rows = np.stack([k, trimmed[0][0][k] - my_bounds[k], trimmed[0][1][k] - my_bounds[k], trimmed[1][0][k] - their_bounds[k], trimmed[1][1][k] - their_bounds[k], both[k], union[k]], axis=1)
    total = np.concatenate([[0], np.cumsum(shared[0])])
    dense = np.flatnonzero(total[least:] - total[:-least] >= -(-least * percent // 100)) if len(mine) >= least else np.zeros(0, np.int64)
    whose = np.searchsorted(my_bounds, dense, "right") - 1
    return rows, np.setdiff1d(whose[dense + least <= my_bounds[whose + 1]], k)


def _joined(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of candidates one after the other, and where each begins."""
    return np.frombuffer(b"".join(blobs), np.uint32), np.concatenate([[0], np.cumsum([len(x) // 4 for x in blobs])]).astype(np.int64)


def possible(mine: np.ndarray, bounds: np.ndarray, low: np.ndarray, high: np.ndarray, table: np.ndarray, least: int, percent: int) -> np.ndarray:
    """Which candidates compared() can find anything in, by their first side alone.  The second sides are ranges of places in
    many texts, of which the table holds shingle << 32 | place, sorted."""
    n = len(bounds) - 1
    whose, key = np.repeat(np.arange(n), np.diff(bounds)), mine.astype(np.uint64) << np.uint64(32)
    at = np.searchsorted(table, key | low.astype(np.uint64)[whose])
    hit = table[np.minimum(at, len(table) - 1)] < (key | high.astype(np.uint64)[whose])
    hit &= at < len(table)
    total = np.concatenate([[0], np.cumsum(hit)])
    dense = np.flatnonzero(total[least:] - total[:-least] >= -(-least * percent // 100)) if len(mine) >= least else np.zeros(0, np.int64)
    out = np.zeros(n, bool)
    dense = dense[dense + least <= bounds[whose[dense] + 1]]
    out[whose[dense]] = True
    # the others could be similar as wholes, from the first shared shingle to the last
    use = np.flatnonzero(~out[whose])
    places = use[hit[use]]
    first, end = bounds[1:].copy(), bounds[:-1].copy()
    np.minimum.at(first, whose[places], places)
    np.maximum.at(end, whose[places], places + 1)
    use = use[(use >= first[whose[use]]) & (use < end[whose[use]]) & (end - first >= least)[whose[use]]]
    one, at = np.unique(whose[use].astype(np.uint64) << np.uint64(32) | mine[use], return_index=True)
    candidate = (one >> np.uint64(32)).astype(np.int64)
    shared, different = np.bincount(candidate, hit[use[at]], n), np.bincount(candidate, minlength=n)
    return out | (100 * shared >= percent * different) & (different > 0)


def _verified(batches: Iterator[pa.RecordBatch], passage: int, percent: int) -> Iterator[pa.RecordBatch]:
    least = passage - SHINGLE + 1
    for batch in slices(batches, "text"):
        grams, bounds = _grams(batch.column("text"))
        short, (row, found) = (grams >> np.uint64(32)).astype(np.uint32), _flat(batch.column("found"))
        ids, a, a_first = batch.column("b").to_numpy()[row], found["a"].to_numpy(), found["a_first"].to_numpy()
        low, high = (np.minimum(bounds[row] + found[c].to_numpy(), bounds[row + 1]) for c in ("b_first", "b_end"))
        blobs = found["grams"].to_pylist()
        ends = np.cumsum([len(x) // 4 for x in blobs])
        table = np.sort(short.astype(np.uint64) << np.uint64(32) | np.arange(len(short), dtype=np.uint64))
        keep, start = [], 0
        while start < len(row):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + STEP_SHINGLES, "right")))
            mine, own = _joined(blobs[start:stop])
            keep.append(start + np.flatnonzero(possible(mine, own, low[start:stop], high[start:stop], table, least, percent)))
            start = stop
        keep = np.concatenate(keep) if keep else np.zeros(0, np.int64)
        row, a, a_first, low, high, ids, blobs = row[keep], a[keep], a_first[keep], low[keep], high[keep], ids[keep], [blobs[k] for k in keep.tolist()]
        ends = np.cumsum([len(x) // 4 for x in blobs])
        start = 0
        while start < len(row):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + STEP_SHINGLES, "right")))
            mine, own = _joined(blobs[start:stop])
            theirs, b_first = short[_ranges(low[start:stop], high[start:stop])[0]], low[start:stop] - bounds[row[start:stop]]
            partner = np.concatenate([[0], np.cumsum(high[start:stop] - low[start:stop])])
            wholes, rest = compared(mine, own, theirs, partner, least, percent)
            out = [(start + r[0], *r[1:5], r[5] / r[6]) for r in wholes.tolist()]
            for k in rest.tolist():
                out += [(start + k, *r) for r in similar_passages(mine[own[k] : own[k + 1]], theirs[partner[k] : partner[k + 1]], least, percent)]
            if out:
                k, i, j, m, n, similar = map(np.array, zip(*out))
                columns = [a[k], a_first[k] + i, a_first[k] + j + SHINGLE - 1, ids[k], b_first[k - start] + m, b_first[k - start] + n + SHINGLE - 1, similar]
                yield pa.RecordBatch.from_arrays([pa.array(x).cast(t) for x, t in zip(columns, [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64()])], _RESULT)
            start = stop


_RESULT = ["doc_id", "start_word", "end_word", "partner_id", "partner_start", "partner_end", "similarity"]
_RESULT_SCHEMA = "doc_id long, start_word int, end_word int, partner_id long, partner_start int, partner_end int, similarity double"


def _placed(hits: DataFrame, passage: int) -> DataFrame:
    """Candidates of the windows that were set against each other."""
    return cut(hits.repartition(partitions(hits.sparkSession), "piece").mapInArrow(lambda it: _candidates(it, passage), "a long, b long, a_first int, a_end int, b_first int, b_end int"))


def _similar(docs: DataFrame, found: DataFrame, passage: int, percent: int) -> DataFrame:
    """Similar passages of candidates: the earlier text meets the shingles of the later one's part."""
    texts = docs.select(F.col("doc_id").alias("a"), "text")
    parts = found.groupBy("b").agg(F.ceil(F.sum(F.col("a_end") - F.col("a_first")) / PART_SHINGLES).alias("parts"))
    found = found.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a", "a_first", "b_first"), F.greatest("parts", F.lit(1))))
    mine = found.groupBy("a").agg(F.collect_list(F.struct("b", "part", "a_first", "a_end", "b_first", "b_end")).alias("found"))
    sent = texts.join(mine, "a", "left").where("found is not null").select("a", "text", "found").mapInArrow(_cut_passages, "a long, b long, part long, a_first int, b_first int, b_end int, grams binary")
    theirs = sent.groupBy("b", "part").agg(F.collect_list(F.struct("a", "a_first", "b_first", "b_end", "grams")).alias("found"))
    return texts.join(theirs.withColumnRenamed("b", "a"), "a", "left").where("found is not null").select(F.col("a").alias("b"), "text", "found").mapInArrow(lambda it: _verified(it, passage, percent), _RESULT_SCHEMA)


def _with_links(left: DataFrame, near: DataFrame) -> DataFrame:
    """Windows with what the pivots' similar passages tell of them: whether their place is in a passage that repeats an earlier
    one, and the first document that theirs is linked to."""
    groups = components(near.select(F.col("doc_id").alias("a"), F.col("partner_id").alias("b"))).withColumnRenamed("node", "doc")
    spans = near.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    inside = F.exists("spans", lambda s: (s.start_word <= F.col("place")) & (F.col("place") <= s.end_word - SHINGLE))
    left = left.join(groups, "doc", "left").join(spans, "doc", "left")
    return left.select("key", "content", "doc", "place", F.coalesce(inside, F.lit(False)).cast("tinyint").alias("covered"), F.coalesce("component", "doc").alias("grp"))


def _not_within(more: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates that are not part of one that was compared before."""
    within = (F.col("m.a") == F.col("f.a")) & (F.col("m.b") == F.col("f.b"))
    for side in ("a", "b"):
        within &= (F.col(f"m.{side}_first") >= F.col(f"f.{side}_first")) & (F.col(f"m.{side}_end") <= F.col(f"f.{side}_end"))
    return more.alias("m").join(found.alias("f"), within, "left_anti")


def repeated_passages(docs: DataFrame, passage: int = PASSAGE_WORDS, percent: int = PERCENT, common: int = COMMON) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, start_word, end_word, partner_id, partner_start, partner_end, similarity).

    A row for each passage of ``passage`` words or more whose shingles are similar, by ``percent``, to those of a passage
    of an earlier document (words from start to before end).  A passage that many documents hold word for word is paired with
    the first of them, and different ones that share a signature with two pivots, and with all others that share it where the
    pivots leave a passage without an earlier partner or two documents unlinked: so the rows link the same documents to
    classes as all pairs would; words about a passage that only another partner shares may be left uncovered.  In passages of which most shingles come more
    than ``common`` times, those that differ in their rarer shingles only are set against the first of these, and against
    those that share such a shingle.  A text that equals an earlier one as a whole is one row, with the first.  Null
    texts and texts shorter than a passage have none; passages within one text do not count; rows without doc_id are
    left out; rows that repeat a doc_id with the same text are one document; of different texts under one doc_id, places are those in
    one of the texts, and a passage that both hold is a row for each place.  Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = no_clash(docs, "doc_id", "text").where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = partitions(spark) * PIECES_PER_PARTITION
    often = spark.sparkContext.broadcast(common_shingles(docs, common))
    packed = "piece long, " + ", ".join(f"c{i} binary" for i in range(4))
    hits = cut(deal(docs, lambda it, pieces: _sent(it, pieces, passage, percent, often.value), 5).mapInArrow(lambda it: _collisions(it, pieces), f"kind int, {packed}"))
    found = _placed(hits.where("kind = 0").drop("kind"), passage)
    texts = cut(docs.join(found.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "doc_id", "left_semi"))
    near = cut(_similar(texts, found, passage, percent).distinct())
    left = _with_links(hits.where("kind = 1").drop("kind").mapInArrow(_left, "key long, content long, doc long, place int"), near)
    more = _placed(deal(left, _tagged, len(_TAGGED)).mapInArrow(lambda it: _apart(it, pieces), packed), passage)
    more = cut(_not_within(more, found))
    release(hits)
    near = near.union(_similar(texts, more, passage, percent)).distinct()
    ids = cut(docs.mapInArrow(_named, "doc_id long, digest binary, n int"))
    firsts = ids.where(F.col("n") >= passage).groupBy("digest").agg(F.min("doc_id").alias("partner_id"), F.max("doc_id").alias("most")).where("partner_id < most").select("digest", "partner_id")
    copies = ids.join(firsts, "digest").where("doc_id > partner_id").distinct()
    zero = F.lit(0)
    copies = copies.select("doc_id", zero.alias("start_word"), F.col("n").alias("end_word"), "partner_id", zero.alias("partner_start"), F.col("n").alias("partner_end"), F.lit(1.0).alias("similarity"))
    return near.unionByName(copies)
