"""Cross-tokenizer alignment: byte offsets where tokens of two tokenizers both end, and the tokens that overlap.

Texts are cut into segments where neither tokenizer can join what stands before and after: before a single space or line
feed between two letters, digits or signs, and between a letter and a punctuation mark, provided that the first splits
texts there and no piece of the second goes on past such a place (otherwise a text is one segment).  The tokens of a
text are those of its segments, so each distinct segment of the corpus is tokenised and aligned once, as relations: tokens by
posexplode, ends by a windowed sum of lengths, both tokenizers' tokens brought together by segment and end, groups by a
running count of the ends they share, and for each end the tokens of either side that cover the byte before it: these
are all overlaps, each once, in linear time.

Documents then gather what is known of their segments, in Arrow batches.  Frequent segments, a bounded number, are known
to all tasks; the others are joined.  An id pair's documents are counted on the pairs that differ within a document.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, no_clash, release, slices

#: Segments that all tasks know: the most frequent ones, of no more bytes than this.
HEAD, HEAD_BYTES = 1 << 18, 48
STEP_BYTES = 1 << 18
PAIRS_HELD = 1 << 20
_SIGN = r"[\p{L}\p{N}\p{P}$+<=>^`|~]"
GAP = rf"(?=[ \n.,;:!?])(?:(?<=\p{{L}})(?=[.,;:!?])|(?<={_SIGN})(?=[ \n]{_SIGN}))"


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the letters of byte-level vocabularies: these bytes stand for themselves, the others follow from 256
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for text, i in self.a.get_vocab().items():
            self.a_bytes[i] = text.encode() if text in special else bytes(byte[c] for c in text)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.vocab_size())))]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x]) for x in (self.a_bytes, self.b_bytes))

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Of segments with their leading space; B adds one itself.  Before others a line feed is put, which stands alone."""
        run = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        a = [e.ids for e in run(segments, add_special_tokens=False)]
        b = self.b.encode([t[1:] if t.startswith(" ") else "\n" + t for t in segments], num_threads=1)
        return a, [x if t.startswith(" ") else x[2:] for x, t in zip(b, segments)]


_loaded: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Tokenizers(a_path, b_path)
    return _loaded[a_path, b_path]


def separable(a_path: str, b_path: str) -> bool:
    """Whether tokens of either side never go on past the places where texts are cut."""
    with open(a_path) as f:
        first = json.load(f)
    own, both = first["pre_tokenizer"] or {}, tokenizers(a_path, b_path)
    if first["normalizer"] or own.get("type") != "ByteLevel" or own.get("add_prefix_space") or not own.get("use_regex", True):
        return False
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(both.b.serialized_model_proto())
    rule = model.normalizer_spec
    plain = rule.add_dummy_prefix and rule.escape_whitespaces and not rule.precompiled_charsmap
    past = lambda p: "\n" in p or any((y == "▁" and x != "▁") or (y in ".,;:!?" and x.isalpha()) for x, y in pairwise(p))
    return plain and both.b.encode("\n") == [both.b.piece_to_id("▁"), both.b.piece_to_id("<0x0A>")] and not any(p.type == p.USER_DEFINED or past(p.piece) for p in model.pieces)


def _tokenised(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    """(id, segment) -> (id, ok, n_a, tok, size): A's tokens, then B's; not ok: the bytes differ from the segment's."""
    both = tokenizers(a_path, b_path)
    for batch in slices(batches, "segment", STEP_BYTES):
        texts = batch.column("segment").to_pylist()
        a, b = both.encode(texts)
        same = [b"".join(map(both.a_bytes.__getitem__, x)) == t.encode() == b"".join(map(both.b_bytes.__getitem__, y)) for x, y, t in zip(a, b, texts)]
        tok = [np.array(x + y if ok else [], np.int32) for x, y, ok in zip(a, b, same)]
        n_a = np.array([len(x) if ok else 0 for x, ok in zip(a, same)], np.int32)
        ends = np.cumsum([0, *map(len, tok)]).astype(np.int32)
        flat = np.concatenate(tok) if tok else np.zeros(0, np.int32)
        left = np.arange(len(flat)) - np.repeat(ends[:-1], np.diff(ends)) < np.repeat(n_a, np.diff(ends))
        size = np.where(left, both.a_sizes[np.minimum(flat, len(both.a_sizes) - 1)], both.b_sizes[np.minimum(flat, len(both.b_sizes) - 1)]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (flat, size)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(same), pa.array(n_a), *lists], ["id", "ok", "n_a", "tok", "size"])


def aligned(tokens: DataFrame) -> DataFrame:
    """(id, n_a, tok, size) -> (id, n_a, n_groups, groups, pairs): each id's alignment.

    tok holds A's tokens and then B's, size their bytes.  groups is ``a1,a2|b1;a3|b2,b3``; pairs holds every link as
    a * 2**32 + b.  Tokens of B are as many as links and groups less tokens of A: where a token ends, a link ends, and
    where tokens of both end, a group.
    """
    rows = tokens.repartition("id").select("id", "n_a", F.posexplode(F.arrays_zip("tok", "size")).alias("pos", "t"))
    rows = rows.select("id", (F.col("pos") >= F.col("n_a")).alias("side"), "pos", "t.tok", "t.size")
    so_far = Window.partitionBy("id", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum("size").over(so_far))
    # the equi-join on id and end, written as a grouping so that its rows stay dealt by id; of each side one token at most ends there
    met = ends.groupBy("id", "end").agg(F.max(F.when(~F.col("side"), F.col("tok"))).alias("a"), F.max(F.when(F.col("side"), F.col("tok"))).alias("b"))
    back = Window.partitionBy("id").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    shared = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)
    links = met.select("id", F.col("a").isNotNull().cast("int").alias("has_a"), "end", "a", "b", F.last("a", True).over(back).alias("of_a"), F.last("b", True).over(back).alias("of_b"), F.count(shared).over(back).alias("group"))
    rows = links.groupBy("id").agg(
        F.sum("has_a").alias("n_a"), F.max("group").alias("n_groups"), F.array_sort(F.collect_list(F.struct("end", "a", "b"))).alias("own"),
        F.collect_list(F.shiftleft(F.col("of_a").cast("long"), 32) + F.col("of_b")).alias("pairs"),
    )

    def lists(side: str, other: str) -> Column:
        """A side's ids of each group; a group's last end is the other side's too."""
        ids = F.transform(F.filter("own", lambda x: x[side].isNotNull()), lambda x: F.concat(x[side].cast("string"), F.when(x[other].isNotNull(), ";").otherwise(",")))
        return F.split(F.rtrim(F.array_join(ids, ""), F.lit(";")), ";")

    groups = F.array_join(F.zip_with(lists("a", "b"), lists("b", "a"), lambda x, y: F.concat(x, F.lit("|"), y)), ";")
    return rows.select("id", "n_a", "n_groups", groups.alias("groups"), "pairs")


CODED = "row long, doc_id long, places binary, rare array<struct<segment string, times long>>"
GATHERED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, good boolean, pair long, docs long"
#: Segments whose facts are looked at in one step; a longer document is a step of its own.
STEP_SEGMENTS = 1 << 20


class Known:
    """What is known of segments, in arrays: counts are n_a, n_b, n_groups, n_links; no links: not ok."""

    def __init__(self, table: pa.Table | pa.RecordBatch):
        of = lambda c: column.combine_chunks() if isinstance(column := table.column(c), pa.ChunkedArray) else column
        self.groups, pairs = pc.binary_join_element_wise(of("groups").cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(";", pa.large_string())), of("pairs")
        n_links = pairs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        n_a, n_groups = (of(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_groups"))
        self.counts = np.stack([n_a, n_links + n_groups - n_a, n_groups, n_links], 1).astype(np.int64)  # a link ends where a token of either side ends
        self.pairs, self.ends = pairs.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n_links)])

    def places_of_pairs(self, places: np.ndarray) -> np.ndarray:
        n = self.ends[places + 1] - self.ends[places]
        return np.repeat(self.ends[places] - np.cumsum(n) + n, n) + np.arange(n.sum())


class Head(Known):
    """The frequent segments; their different pairs have numbers."""

    def __init__(self, table: pa.Table):
        super().__init__(table)
        self.segments = table.column("segment").combine_chunks()
        self.names, self.number = np.unique(self.pairs, return_inverse=True)


_head: dict[bytes, Head] = {}


def _of_head(head: bytes) -> Head:
    """Read once by a worker."""
    mark = hashlib.blake2b(head, digest_size=16).digest()
    if mark not in _head:
        _head.clear()
        _head[mark] = Head(pa.ipc.open_stream(head).read_all())
    return _head[mark]


def _planes(places: np.ndarray) -> bytes:
    """Bytes of 32-bit numbers, all first bytes before all second ones and so on: of small numbers most are alike."""
    return places.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _places(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _coded(batches: Iterator[pa.RecordBatch], head: bytes) -> Iterator[pa.RecordBatch]:
    """Segments as places in the head; the others, in order, as -1, -2, ... with how often they occur."""
    known = _of_head(head).segments
    squeeze = zstandard.ZstdCompressor(level=1).compress
    kind = pa.list_(pa.struct([("segment", pa.string()), ("times", pa.int64())]))
    for batch in batches:
        column = batch.column("segments")
        flat = column.flatten()
        at = pc.fill_null(pc.index_in(flat, known), -1).to_numpy(zero_copy_only=False).copy()
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False))])
        free = np.flatnonzero(at < 0)
        other, first = flat.take(pa.array(free)).to_pylist(), np.searchsorted(free, ends).tolist()
        blobs, rare = [], []
        for i, valid in enumerate(column.is_valid().to_pylist()):
            mine = other[first[i] : first[i + 1]]
            times = Counter(mine)
            order = {s: -1 - k for k, s in enumerate(sorted(times))}
            at[free[first[i] : first[i + 1]]] = [order[s] for s in mine]
            blobs.append(squeeze(_planes(at[ends[i] : ends[i + 1]])) if valid else None)
            rare.append([{"segment": s, "times": times[s]} for s in order])
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(blobs, pa.binary()), pa.array(rare, kind)], ["row", "doc_id", "places", "rare"])


def _gathered(batches: Iterator[pa.RecordBatch], head: bytes) -> Iterator[pa.RecordBatch]:
    """A row for each document, and rows (pair, docs) for the pairs of the documents seen."""
    known, held = _of_head(head), []
    docs_of = np.zeros(len(known.names), np.int64)  # by number of a pair of the head
    expand = zstandard.ZstdDecompressor().decompress
    names = [f.split()[0] for f in GATHERED.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string(), pa.bool_(), pa.int64(), pa.int64()]
    size = len(known.counts)

    def counted(pair: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(pair))
        return pa.RecordBatch.from_arrays([*[none.cast(k) for k in kinds[:-2]], pa.array(pair), pa.array(docs)], names)

    def step(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Rows (row, doc_id, places in the head and, behind it, in the others, or null)."""
        at = np.concatenate([r[2] for r in rows if r[2] is not None] or [np.zeros(0, np.int64)])
        text = groups.take(pa.array(at))
        bounds = np.frombuffer(text.buffers()[1], np.int64, len(at) + 1, 8 * text.offset) if len(at) else np.zeros(1, np.int64)
        data, own_counts, out, start = memoryview(text.buffers()[2] or b""), counts[at], [], 0
        for row, doc_id, places in rows:
            if places is not None:
                stop = start + len(places)
                here = own_counts[start:stop]
                good = bool((here[:, 3] > 0).all())
                digest = hashlib.sha256(data[bounds[start] : bounds[stop] - 1]).hexdigest() if good else ""
                start = stop
            if places is None or not good:
                out.append((row, doc_id, 0, 0, 0, 0, "", False, None, None))
                continue
            out.append((row, doc_id, *here.sum(0).tolist(), digest, True, None, None))
            some = np.unique(places)
            rest = others.places_of_pairs(some[some >= size] - size)
            number = numbers[rest]
            docs_of[np.unique(np.concatenate([known.number[known.places_of_pairs(some[some < size])], number[number >= 0]]))] += 1
            if (number < 0).any():
                held.append((np.unique(others.pairs[rest[number < 0]]), None))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        if sum(len(p) for p, _ in held) > PAIRS_HELD:
            held[:] = [_pair_sums(held)]
            if len(held[0][0]) > PAIRS_HELD // 2:
                yield counted(*held.pop())

    for batch in batches:
        own = batch.column("own")
        others = Known(pa.Table.from_struct_array(own.flatten()))
        groups, counts = pa.concat_arrays([known.groups, others.groups]), np.concatenate([known.counts, others.counts])
        at = np.minimum(np.searchsorted(known.names, others.pairs), max(len(known.names) - 1, 0))
        numbers = np.where(known.names[at] == others.pairs, at, -1) if len(known.names) else np.full(len(others.pairs), -1)
        rank = own.flatten().field("rank").to_numpy(zero_copy_only=False)
        first = np.concatenate([[0], np.cumsum(pc.fill_null(own.value_lengths(), 0).to_numpy(zero_copy_only=False))]).tolist()
        rows, held_segments = [], 0
        for i, (row, doc_id, blob) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "places")))):
            places = None
            if blob is not None:
                places = _places(expand(blob)).astype(np.int64)
                if first[i] < first[i + 1]:
                    mine = np.empty(first[i + 1] - first[i], np.int64)
                    mine[rank[first[i] : first[i + 1]]] = np.arange(size + first[i], size + first[i + 1])
                    places[places < 0] = mine[-1 - places[places < 0]]
                held_segments += len(places)
            rows.append((row, doc_id, places))
            if held_segments > STEP_SEGMENTS:
                yield from step(rows)
                rows, held_segments = [], 0
        if rows:
            yield from step(rows)
    some = np.flatnonzero(docs_of)
    if len(some):
        yield counted(known.names[some], docs_of[some])
    if held:
        yield counted(*_pair_sums(held))


def _worth(batches: Iterator[pa.RecordBatch], worth: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(row, count_sum, n_best) of a document's frequent segments; ``worth`` has a row for each place."""
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        sums = np.zeros((batch.num_rows, 2), np.int64)
        for i, blob in enumerate(batch.column("places").to_pylist()):
            if blob is not None:
                at = _places(expand(blob))
                sums[i] = worth[at[at >= 0]].sum(0)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy())], ["row", "count_sum", "n_best"])


def _pair_sums(held: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray]:
    pair = np.concatenate([p for p, _ in held])
    n = np.concatenate([np.ones(len(p), np.int64) if c is None else c for p, c in held])
    some, at = np.unique(pair, return_inverse=True)
    return some, np.bincount(at, n, len(some)).astype(np.int64)


def _frequent(segments: DataFrame) -> Column:
    """Whether a segment is among the head: counts are told apart by eighths of their logarithm, of which there are few."""
    step = F.floor(8 * F.log2("n")).cast("int")
    fits = F.octet_length("segment") <= HEAD_BYTES
    sizes = {r.step: r["count"] for r in segments.where(fits).groupBy(step.alias("step")).count().collect()}
    least, seen = None, 0
    for s in sorted(sizes, reverse=True):
        seen += sizes[s]
        if seen > HEAD:
            break
        least = s
    return fits & (step >= F.lit(least)) if least is not None else F.lit(False)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each row.

    A encodes a space and the text, B the text, to which it adds the space itself, both without special tokens.  Byte offsets
    where tokens of both end cut the tokens into groups; links are the pairs of tokens whose byte ranges overlap.  An id pair's
    count is the number of rows that hold it linked; n_best counts links whose count is the highest of their A id (ties
    included), count_sum adds the counts up.  Texts that are null or empty, or whose joined token bytes of either side differ
    from space and text, have no tokens: zeros and an empty groups_sha256.  Repeated rows and rows without doc_id are rows of
    their own.  Other columns are ignored.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = no_clash(docs, "doc_id", "text")
    text = F.concat(F.lit(" "), F.when(F.col("text") != "", F.col("text")))
    segments = F.split(text, GAP, -1) if separable(a_path, b_path) else F.when(text.isNotNull(), F.array(text))
    found = docs.select(F.explode(segments).alias("segment")).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    found = cut(found.withColumn("id", F.monotonically_increasing_id()))
    tokens = found.select("id", "segment").mapInArrow(lambda it: _tokenised(it, a_path, b_path), "id long, ok boolean, n_a int, tok array<int>, size array<int>")
    facts = aligned(tokens.where("ok").drop("ok"))
    none = F.expr("cast(array() as array<bigint>)")
    facts = found.join(facts, "id", "left").select("id", "segment", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_a", "n_groups")], F.coalesce("groups", F.lit("")).alias("groups"), F.coalesce("pairs", none).alias("pairs"))
    facts = cut(facts.withColumn("head", _frequent(found)))
    release(found)
    table = facts.where("head").select("n", "id", "segment", "n_a", "n_groups", "groups", "pairs").toArrow()  # HEAD rows at most
    table = table.sort_by([("n", "descending"), ("id", "ascending")]).drop_columns(["n"])  # frequent ones have small places
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    head_ids = table.column("id").to_numpy()
    shared = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    del table, sink

    coded = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), segments.alias("segments"))
    coded = cut(coded.mapInArrow(lambda it: _coded(it, shared.value), CODED))
    rare = coded.select("row", F.posexplode("rare").alias("rank", "r")).select("row", "rank", "r.segment", "r.times")
    rare = rare.join(facts.where("not head").select("segment", "id", "n_a", "n_groups", "groups", "pairs"), "segment")
    own = cut(rare.groupBy("row").agg(F.collect_list(F.struct("rank", "id", "times", "n_a", "n_groups", "groups", "pairs")).alias("own")))
    gathered = cut(coded.drop("rare").join(own, "row", "left").mapInArrow(lambda it: _gathered(it, shared.value), GATHERED))

    pairs = cut(gathered.where("pair is not null").groupBy("pair").agg(F.sum("docs").alias("docs")))
    a_id = F.shiftright("pair", 32)
    best = pairs.groupBy(a_id.alias("a")).agg(F.max("docs").alias("best"))  # a row for each id of A's vocabulary at most
    counts = pairs.withColumn("a", a_id).join(F.broadcast(best), "a").select("pair", "docs", (F.col("docs") == F.col("best")).cast("long").alias("is_best"))
    worth = facts.select("id", "head", F.explode("pairs").alias("pair")).join(counts, "pair").groupBy("id", "head").agg(F.sum("docs").alias("count_sum"), F.sum("is_best").alias("n_best"))
    worth = cut(worth)
    of_head = worth.where("head").select("id", "count_sum", "n_best").toArrow()
    by_place = np.zeros((len(head_ids), 2), np.int64)
    order = np.argsort(head_ids)
    by_place[order[np.searchsorted(head_ids[order], of_head.column("id").to_numpy())]] = np.stack([of_head.column(c).to_numpy() for c in ("count_sum", "n_best")], 1) if len(of_head) else by_place[:0]
    placed = spark.sparkContext.broadcast(by_place)
    frequent = coded.select("row", "places").mapInArrow(lambda it: _worth(it, placed.value), "row long, count_sum long, n_best long")
    others = own.select("row", F.explode(F.transform("own", lambda x: F.struct(x["id"].alias("id"), x["times"].alias("times")))).alias("x")).select("row", "x.id", "x.times")
    others = others.join(worth.where("not head"), "id").select("row", (F.col("count_sum") * F.col("times")).alias("count_sum"), (F.col("n_best") * F.col("times")).alias("n_best"))
    sums = frequent.union(others).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    rows = gathered.where("row is not null").join(sums, "row", "left")
    of = lambda c: F.when(F.col("good"), F.coalesce(c, F.lit(0))).otherwise(0).alias(c)
    out = cut(rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", of("n_best"), of("count_sum"), "groups_sha256"))
    release(facts, coded, own, gathered, pairs, worth)
    return out
