"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

An item is a sequence of words; a text is contaminated by it if some run of the text's words is within an edit distance
of a fifth of the item's words.  Windows as long as an item are embedded by random walks (Chakraborty, Goldenberg and
Koucky, 2016): a walk over the window emits a word a step and goes on to the next word, or not, as a random bit of the
step and the word says, so that windows at small edit distance emit strings at small Hamming distance.  Samples of a few
emitted positions are hash keys; several walks and samples, as many as reach the wished recall on edited items, give
the candidates, and each candidate is verified by the exact edit distance.

Before a window is walked, a count must hold that every match meets: an edit spoils GRAM runs of GRAM words at most, so
that the window has all of the item's other runs.  Where MOST_WALKS do not reach the recall for a number of words, as
for long items, its items are not walked: all windows for which the count holds by the item's own runs are candidates,
which misses none.  Items go to the tasks in blocks of bounded size; a larger benchmark
takes several passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filtered_batches, give_back, joined_bytes, mix, no_clash, slices, words

#: Allowed edits of an item, in hundredths of its words.
EDITS_PERCENT = 20
RECALL, MOST_WALKS = 0.97, 24
#: Edited copies, at least, on which the recall of the items of one number of words is judged; fewer in bands of many
#: long sizes.
PROBES, PROBE_WORDS = 400, 1 << 24
SAMPLES, SAMPLED, STEPS_PER_WORD = 4, 5, 2
#: Items of one band differ by this factor at most.
BAND = 1.5
#: Words of the runs that are counted, or single words where so short an item need not keep any run.
GRAM = 3
TABLE_BITS = 20
#: Text bytes of the items that one pass takes to its tasks.
BLOCK_BYTES = 16 << 20
CHUNK, STEP = 1 << 16, 4 << 20
_PAD = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass
class Size:
    """Items of ``n`` words: which of the benchmark's runs they have."""

    n: int
    edits: int
    gram: int
    has: np.ndarray
    #: Where the walks miss the recall, the items' own runs: (rows of the band's items, run numbers, where each item's begin).
    counted: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


@dataclass
class Band:
    """Items of nearly the same number of words, which share their walks and sampled steps."""

    sizes: list[Size]
    items: np.ndarray  # [items, words of the longest], filled up
    n: np.ndarray
    ids: np.ndarray
    samples: list[np.ndarray]  # of each walk
    keys: list[tuple[np.ndarray, np.ndarray]]  # of each walk and sample: sorted keys and their items


def edits_allowed(n: int, percent: int = EDITS_PERCENT) -> int:
    return n * percent // 100


def walk(rows: np.ndarray, n: np.ndarray, seed: int, samples: np.ndarray) -> np.ndarray:
    """Keys [samples, rows] of word windows [rows, most words] of ``n`` words each: the emitted words at the sampled
    steps, hashed.  After its last word a walk emits a filler."""
    count, width = rows.shape
    at = np.arange(count) * (width + 1)
    end = at + n
    padded = np.concatenate([rows, np.full((count, 1), _PAD)], axis=1).ravel()
    keys = np.zeros((len(samples), count), np.uint64)
    wanted: dict[int, list[int]] = {}
    for k, steps in enumerate(samples.tolist()):
        for step in steps:
            wanted.setdefault(step, []).append(k)
    for step in range(int(samples.max()) + 1):
        if step % 64 == 0:  # each word has a bit for each of the next steps
            bits = mix(padded ^ np.uint64((seed * 4096 + step + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        for k in wanted.get(step, ()):
            keys[k] = (keys[k] ^ padded[at] ^ np.uint64(step)) * np.uint64(0xD6E8FEB86659FD93)
        at = np.minimum(at + (bits[at] >> np.uint64(step % 64) & np.uint64(1)).astype(np.int64), end)
    return mix(keys)


def _samples(least: int, seed: int) -> np.ndarray:
    """Steps of each sample, up to where a walk over the band's shortest items ends."""
    rng = np.random.default_rng([least, seed])
    return np.stack([rng.choice(max(SAMPLED, STEPS_PER_WORD * least), SAMPLED, replace=False) for _ in range(SAMPLES)])


def edit_distance(item: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Least edits between an item [k, n] and any run of the words of its row [k, m]."""
    return _edits_to(item, rows).min(1)


def _edits_to(item: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Least edits [k, m + 1] between an item and a run that ends before each word of its row, or after the last."""
    column = np.arange(rows.shape[1] + 1)
    line = np.zeros((len(rows), rows.shape[1] + 1), np.int64)
    for i in range(item.shape[1]):
        new = np.empty_like(line)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(line[:, :-1] + (rows != item[:, i : i + 1]), line[:, 1:] + 1)
        line = np.minimum.accumulate(new - column, axis=1) + column
    return line


def _edited(item: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """A copy with as many random edits, cut or filled to the same number of words."""
    now = list(item)
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(len(now))) if now else 0
        if kind == 0 and now:
            now[at] = rng.integers(1 << 62)
        elif kind == 1 and now:
            del now[at]
        else:
            now.insert(at, rng.integers(1 << 62))
    return np.array((now + list(rng.integers(1 << 62, size=edits)))[: len(item)], np.uint64)


def index(texts: list[tuple[int, str]], percent: int = EDITS_PERCENT) -> tuple[list[Band], dict[int, np.ndarray]]:
    """Items by band with as many walks as reach the recall on edited copies; the sorted hashes of their words and runs."""
    data, starts = joined_bytes(pa.array([t for _, t in texts], pa.string()))
    hashes, _, _, bounds = words(data, starts, True)
    known = {gram: np.unique(_runs(hashes, gram)) for gram in (1, GRAM)}
    by_band: dict[int, list[int]] = {}
    for i, n in enumerate(np.diff(bounds)):
        if n:
            by_band.setdefault(int(np.log(n) / np.log(BAND)), []).append(i)
    bands, walks = [], MOST_WALKS
    for _, own in sorted(by_band.items()):
        n = np.diff(bounds)[own]
        items = np.full((len(own), n.max()), _PAD)
        for row, i in enumerate(own):
            items[row, : n[row]] = hashes[bounds[i] : bounds[i + 1]]
        sizes = []
        for size in np.unique(n).tolist():
            edits = edits_allowed(size, percent)
            gram = GRAM if size + 1 - GRAM - GRAM * edits > 0 else 1
            runs = np.concatenate([_runs(item[:size], gram)[: size + 1 - gram] for item in items[n == size]])
            sizes.append(Size(size, edits, gram, np.isin(known[gram], runs)))
        # probes of each size, as longer items are harder to find; once a whole band was missed, longer ones are not tried
        rng, probes = np.random.default_rng(len(own)), max(20, min(PROBES, PROBE_WORDS // (len(sizes) * items.shape[1])))
        source = np.concatenate([np.tile(np.flatnonzero(n == s.n), -(-probes // (n == s.n).sum())) for s in sizes]) if walks else np.zeros(0, np.int64)
        probe = items[source]
        for row, i in enumerate(source):
            probe[row, : n[i]] = _edited(items[i, : n[i]], edits_allowed(int(n[i]), percent), rng)
        hit, keys, samples, reached = np.zeros(len(probe), bool), [], [], {}
        for seed in range(MOST_WALKS if walks else 0):
            samples.append(_samples(int(n.min()), seed))
            mine, theirs = walk(items, n, seed, samples[-1]), walk(probe, n[source], seed, samples[-1])
            for k in range(SAMPLES):
                order = np.argsort(mine[k], kind="stable")
                keys.append((mine[k][order], order))
                hit |= theirs[k] == mine[k][source]
            for s in sizes:
                if s.n not in reached and hit[n[source] == s.n].mean() >= RECALL:
                    reached[s.n] = seed + 1
            if len(reached) == len(sizes):
                break
        walks = max(reached.values(), default=0)
        for s in sizes:
            if s.n not in reached:
                rows = np.flatnonzero(n == s.n)
                runs = [np.searchsorted(known[s.gram], np.unique(_runs(items[i, : s.n], s.gram)[: s.n + 1 - s.gram])) for i in rows]
                s.counted = rows, np.concatenate(runs), np.cumsum([0, *map(len, runs)])
        bands.append(Band(sizes, items, n, np.array([texts[i][0] for i in own]), samples[:walks], keys[: walks * SAMPLES]))
    return bands, known


def _runs(hashes: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` words from each word on; runs across texts are harmless."""
    padded, out = np.concatenate([hashes, np.zeros(gram - 1, np.uint64)]), np.zeros(len(hashes), np.uint64)
    for j in range(gram):
        out = out * np.uint64(0xD6E8FEB86659FD93) + padded[j : j + len(hashes)]
    return mix(out)


def _hits(runs: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the benchmark's runs and which they are, by a table of bits and then exactly."""
    table = np.zeros(1 << TABLE_BITS, bool)
    table[wanted >> np.uint64(64 - TABLE_BITS)] = True
    some = np.flatnonzero(table[runs >> np.uint64(64 - TABLE_BITS)])
    which = np.minimum(np.searchsorted(wanted, runs[some]), len(wanted) - 1)
    fits = wanted[which] == runs[some]
    return some[fits], which[fits]


def _enough(place: np.ndarray, bounds: np.ndarray, s: Size) -> np.ndarray:
    """First words of the windows that have enough of the runs at these places."""
    need, reach = s.n + 1 - s.gram - s.gram * s.edits, s.n - s.gram
    k = np.flatnonzero(place[need - 1 :] - place[: len(place) - need + 1] <= reach) if len(place) >= need else np.zeros(0, np.int64)
    low, high = place[k + need - 1] - reach, place[k]
    first = np.unique(np.repeat(low - np.concatenate([[0], np.cumsum(high - low + 1)[:-1]]), high - low + 1) + np.arange((high - low + 1).sum())) if len(k) else k
    first = first[first >= 0]
    doc = np.searchsorted(bounds, first, "right") - 1
    return first[first + s.n <= bounds[doc + 1]]


def _windows(bounds: np.ndarray, sizes: list[Size], hits: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[Size, np.ndarray]]:
    """For each size the first words of the windows that have enough runs of its items; a text that is shorter, but not
    by more than the edits, is one window."""
    count = np.diff(bounds)
    for s in sizes:
        place, which = hits[s.gram]
        yield s, np.concatenate([_enough(place[s.has[which]], bounds, s), bounds[:-1][(count < s.n) & (count >= s.n - s.edits)]])


def _counted(hashes: np.ndarray, bounds: np.ndarray, band: Band, s: Size, hits: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, int, int, int]]:
    """Matches, as _matches() gives them, of all windows that have enough of an item's own runs.

    A row reaches as far as the edits beyond its window on both sides, so that of neighbouring windows each one after as
    many steps, and the last, see every match; where it ends tells the first window that sees it.
    """
    place, which = hits[s.gram]
    order = np.argsort(which, kind="stable")
    place, which = place[order], which[order]
    rows, runs, begin = s.counted
    low, high = np.searchsorted(which, runs), np.searchsorted(which, runs, "right")
    total = np.concatenate([[0], np.cumsum(high - low)])
    need, count = s.n + 1 - s.gram - s.gram * s.edits, np.diff(bounds)
    short = (count < s.n) & (count >= s.n - s.edits)
    step = max(1, STEP // 8 // (s.n + 2 * s.edits))
    for j in np.flatnonzero(total[begin[1:]] - total[begin[:-1]] >= need):
        own = np.sort(np.concatenate([place[a:b] for a, b in zip(low[begin[j] : begin[j + 1]], high[begin[j] : begin[j + 1]])]))
        full = _enough(own, bounds, s)
        run = np.concatenate([[True], np.diff(full) > 1]) if len(full) else np.zeros(0, bool)
        since = np.arange(len(full)) - np.maximum.accumulate(np.where(run, np.arange(len(full)), 0)) if len(full) else full
        some = full[(since % (s.edits + 1) == 0) | np.concatenate([run[1:], [True]])] if len(full) else full
        held = np.searchsorted(own, bounds[1:]) - np.searchsorted(own, bounds[:-1])
        first = np.concatenate([some, bounds[:-1][short & (held >= need)]])
        for part in range(0, len(first), step):
            at = first[part : part + step]
            doc = np.searchsorted(bounds, at, "right") - 1
            around = at[:, None] + np.arange(-s.edits, s.n + s.edits)
            inside = (around >= bounds[doc][:, None]) & (around < bounds[doc + 1][:, None])
            near = np.where(inside, hashes[np.clip(around, 0, len(hashes) - 1)], _PAD - np.uint64(1))
            line = _edits_to(np.repeat(band.items[rows[j] : rows[j] + 1, : s.n], len(at), 0), near)
            far, end = line.min(1), at - s.edits + line.argmin(1)
            for w in np.flatnonzero(far <= s.edits):
                start = int(at[w])
                if count[doc[w]] >= s.n:
                    start = int(full[np.searchsorted(full, max(end[w] - s.n - s.edits, bounds[doc[w]]))])
                yield int(doc[w]), int(band.ids[rows[j]]), int(far[w]), start - int(bounds[doc[w]]), s.n


def _matches(hashes: np.ndarray, bounds: np.ndarray, index_: tuple[list[Band], dict[int, np.ndarray]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item_id, edits, first word, words) of verified windows."""
    bands, known = index_
    hits = {gram: _hits(_runs(hashes, gram), known[gram]) for gram in {s.gram for band in bands for s in band.sizes}}
    for band in bands:
        for s in band.sizes:
            if s.counted:
                yield from _counted(hashes, bounds, band, s, hits)
        walked = [s for s in band.sizes if not s.counted]
        found_at = [(s, first) for s, first in _windows(bounds, walked, hits) if len(first)]
        if not found_at:
            continue
        width = band.items.shape[1]
        margin = max(s.edits for s in band.sizes)
        fill = np.full(width + margin, _PAD - np.uint64(1))
        padded = np.concatenate([fill, hashes, fill])
        all_first, all_n = np.concatenate([f for _, f in found_at]), np.concatenate([np.full(len(f), s.n) for s, f in found_at])
        for part in range(0, len(all_first), CHUNK):
            first, n = all_first[part : part + CHUNK], all_n[part : part + CHUNK]
            doc = np.searchsorted(bounds, first, "right") - 1
            column = first[:, None] + np.arange(width)
            rows = np.where((column < bounds[doc + 1][:, None]) & (column < (first + n)[:, None]), padded[column + len(fill)], _PAD)
            found: set[tuple[int, int]] = set()
            for seed, samples in enumerate(band.samples):
                for k, key in enumerate(walk(rows, n, seed, samples)):
                    mine, order = band.keys[seed * SAMPLES + k]
                    low, high = np.searchsorted(mine, key), np.searchsorted(mine, key, "right")
                    for w in np.flatnonzero(high > low):
                        found.update((int(w), int(i)) for i in order[low[w] : high[w]] if band.n[i] == n[w])
            pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
            for size in walked:
                own = pairs[n[pairs[:, 0]] == size.n]
                around = first[own[:, 0]][:, None] + np.arange(-size.edits, size.n + size.edits)
                near = doc[own[:, 0]][:, None]
                rows_near = np.where((around >= bounds[near]) & (around < bounds[near + 1]), padded[around + len(fill)], _PAD - np.uint64(1))
                far = edit_distance(band.items[own[:, 1], : size.n], rows_near)
                for (w, i), edits in zip(own[far <= size.edits], far[far <= size.edits]):
                    yield int(doc[w]), int(band.ids[i]), int(edits), int(first[w] - bounds[doc[w]]), size.n


def _found(batches: Iterator[pa.RecordBatch], index_: tuple[list[Band], dict[int, np.ndarray]]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, int, int, int]]]]:
    for batch in slices(batches, "text", STEP):
        data, starts = joined_bytes(batch.column("text"))
        hashes, _, _, bounds = words(data, starts, True)
        yield batch, list(_matches(hashes, bounds, index_))


def _blocks(spark: SparkSession, benchmark: DataFrame, percent: int) -> Iterator[Broadcast]:
    """Indexes of the items, in blocks of about BLOCK_BYTES of text."""
    items = no_clash(benchmark, "item_id", "text").where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        yield spark.sparkContext.broadcast(index([(r.item_id, r.text) for r in own], percent))


_SCHEMA = "doc_id long, item_id long, edits int, start_word int, n_words int"


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = EDITS_PERCENT) -> DataFrame:
    """(doc_id, text), (item_id, text) -> (doc_id, item_id, edits, start_word, n_words): a row for each matching pair.

    Words are runs of bytes other than white space, with A-Z lowered.  ``edits`` is the least edit distance met,
    ``start_word`` the first window with it, ``n_words`` the item's length.  Items and texts that are null or without
    words match nothing; items too short for an edit match exactly; equal items match each by itself.  Rows without id
    are left out; rows that repeat a doc_id count as one document.  Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = no_clash(docs, "doc_id", "text").where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], _SCHEMA)
    for sent in _blocks(spark, benchmark, percent):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch, rows in _found(batches, sent.value):
                if rows:
                    doc, item, edits, start, n = zip(*rows)
                    ids = batch.column("doc_id").to_numpy()[list(doc)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(item, pa.int64()), *[pa.array(x, pa.int32()) for x in (edits, start, n)]], ["doc_id", "item_id", "edits", "start_word", "n_words"])

        out = out.unionByName(docs.mapInArrow(run, _SCHEMA))
    best = out.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "start_word", "n_words")).alias("best"))
    return best.select("doc_id", "item_id", "best.*")


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = EDITS_PERCENT) -> DataFrame:
    """The rows, with all their columns, whose text matches no item; as contaminated() finds them."""
    for sent in _blocks(docs.sparkSession, benchmark, percent):

        def kept(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch, rows in _found(batches, sent.value):
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in rows]] = False
                yield batch.filter(pa.array(keep))
            give_back()

        docs = filtered_batches(docs, kept)
    return docs
