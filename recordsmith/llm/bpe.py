"""Byte-level BPE encoding and decoding with DuckDB recursive queries in each partition.

A word (a match of the splitting pattern) that is no token as a whole starts as one row for each byte.  A recursive
query joins the rows, each with the id that follows it, with the merge table and contracts the leftmost pair of least
rank, a pair for each word and round, until no pair of any word has a merge.  An aggregation ordered by position
decodes.  Words are encoded once for each Python worker, as far as a bounded cache goes; texts are then put together
from their words.

A very long word would take a round for each of its merges.  Its pairs can only be spoilt by tokens that begin or end
with theirs, so each pair that is the leftmost of least rank as far as such tokens reach is contracted in the same
round: the order among pairs that far apart does not matter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, no_clash, slices

#: Words that a Python worker keeps; beyond that the half met last stays.
CACHE_WORDS = 400_000
#: Words of one recursive query, and their bytes; longer words than LONG bytes go by themselves.
QUERY_WORDS, QUERY_BYTES, LONG = 32_000, 500_000, 128
#: Bytes of text that are put together at a time.
STEP = 2 << 20

#: A row's key is its word's number times PLACES plus its position; a pair's key is likewise made of two ids.
PLACES = 1 << 28
NONE = PLACES - 1
ENCODE = f"""
WITH RECURSIVE rows AS (
  SELECT 0 AS step, key, id, next FROM bytes
  UNION ALL
  SELECT r.step + 1, r.key - (r.key > l.at)::BIGINT, CASE WHEN r.key = l.at + 1 THEN l.id ELSE r.id END, CASE WHEN r.key = l.at - 1 THEN l.id ELSE r.next END
  FROM rows r JOIN (
    SELECT word, low // {PLACES} AS id, word * {PLACES} + low % {PLACES} AS at FROM (
      SELECT a.key // {PLACES} AS word, min(m.id * {PLACES} + a.key % {PLACES}) AS low FROM rows a JOIN merges m ON m.pair = a.id * {PLACES} + a.next GROUP BY 1
    )
  ) l ON l.word = r.key // {PLACES} WHERE r.key <> l.at
), last AS (
  SELECT key // {PLACES} AS word, max(step) AS step FROM rows GROUP BY 1
), done AS (
  SELECT l.word, r.key AS place, r.id FROM rows r JOIN last l ON l.word = r.key // {PLACES} AND l.step = r.step
)
"""
#: One word, whose rows are keyed by their first byte; only a row's last state is kept (id null: contracted away).  ``low``
#: is the least rank within reach; of equal pairs that overlap, as in a run of one letter, every second is contracted if
#: all before are as low and no merge of their token ranks before it (safe).
ENCODE_LONG = f"""
WITH RECURSIVE rows (key, id) USING KEY (key) AS (
  SELECT key, id FROM bytes
  UNION
  SELECT CASE gone WHEN 0 THEN key ELSE next_key END, CASE gone WHEN 0 THEN merged END FROM (
    SELECT *, row_number() OVER (PARTITION BY run ORDER BY key) % 2 = 1 AND bool_and(low = merged) OVER (PARTITION BY run ORDER BY key) AS turn FROM (
      SELECT *, sum(starts) OVER (ORDER BY key) AS run FROM (
        SELECT *, min(merged) OVER within AS low, min(merged * {PLACES} + key) OVER within AS first,
          CASE WHEN lag(merged) OVER (ORDER BY key) = merged AND lag(next_key) OVER (ORDER BY key) = key THEN 0 ELSE 1 END AS starts
        FROM (
          SELECT p.key, p.next_key, m.id AS merged, l.before, p.next_key - p.key + r.after AS after, c.safe
          FROM (SELECT key, id, lead(key) OVER (ORDER BY key) AS next_key, lead(id) OVER (ORDER BY key) AS next FROM recurring.rows WHERE id IS NOT NULL) p
          JOIN merges m ON m.pair = p.id * {PLACES} + p.next JOIN reach l ON l.id = p.id JOIN reach r ON r.id = p.next JOIN reach c ON c.id = m.id
        ) WINDOW within AS (ORDER BY key RANGE BETWEEN before PRECEDING AND after FOLLOWING)
      )
    )
  ) q JOIN (VALUES (0), (1)) e (gone) ON first = merged * {PLACES} + key OR (turn AND safe)
), done AS (
  SELECT 0 AS word, key AS place, id FROM rows WHERE id IS NOT NULL
)
"""
WORDS = """
SELECT d.word, string_agg(CAST(d.id AS VARCHAR), ' ' ORDER BY d.place) || ' ' AS ids, count(*) AS n, unhex(string_agg(v.hex, '' ORDER BY d.place)) AS decoded
FROM {rows} d JOIN vocabulary v ON v.id = d.id GROUP BY d.word
"""


class Codec:
    """Ranks in a DuckDB database of its own, in memory."""

    def __init__(self, ranks: bytes, pattern: str):
        self.split = regex.compile(pattern).findall
        pairs = [line.split() for line in ranks.splitlines() if line]
        rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.whole = {}
        for token, id_ in rank.items():
            try:
                self.whole[token.decode()] = id_
            except UnicodeDecodeError:
                pass
        self.single = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        merges = [(rank[t[:i]] * PLACES + rank[t[i:]], r) for t, r in rank.items() for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank]
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        pair, ids = (pa.array(x, pa.int64()) for x in zip(*merges))
        self._table("merges", pa.table({"pair": pair, "id": ids}))
        self._table("vocabulary", pa.table({"id": pa.array(list(rank.values()), pa.int64()), "hex": pa.array([t.hex() for t in rank])}))
        self.rank = rank
        self.has_reach = False
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.ids = self.decoded = pa.array([], pa.large_binary())
        self.n = self.met = np.zeros(0, np.int64)
        self.turn = 0

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("arriving", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM arriving")
        self.db.unregister("arriving")

    def _reach(self) -> None:
        """By how many bytes the longest token that ends with a token exceeds it, and the longest that begins with it."""
        before, after = dict.fromkeys(self.rank, 0), dict.fromkeys(self.rank, 0)
        for token in self.rank:
            for i in range(1, len(token)):
                if token[i:] in before:
                    before[token[i:]] = max(before[token[i:]], i)
                if token[:i] in after:
                    after[token[:i]] = max(after[token[:i]], len(token) - i)
        columns = {"id": self.rank.values(), "before": before.values(), "after": after.values()}
        self._table("reach", pa.table({k: pa.array(list(v), pa.int64()) for k, v in columns.items()}))
        used = f"SELECT pair // {PLACES} AS part, id FROM merges UNION ALL SELECT pair % {PLACES}, id FROM merges"
        self.db.execute(f"CREATE OR REPLACE TABLE reach AS SELECT r.id, before, after, coalesce(min(u.id) > r.id, true) AS safe FROM reach r LEFT JOIN ({used}) u ON u.part = r.id GROUP BY r.id, before, after")
        self.has_reach = True

    def _encoded(self, words: list[bytes]) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """Ids (each followed by a blank), their number and their decoded bytes, for words that are no tokens."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        key = np.arange(size.sum()) + np.repeat(np.arange(len(words)) * PLACES - start, size)
        id_ = self.single[np.frombuffer(b"".join(words), np.uint8)]
        if len(words) == 1 and size[0] > LONG:
            if not self.has_reach:
                self._reach()
            self._table("bytes", pa.table({"key": key, "id": id_}))
            query = ENCODE_LONG
        else:
            after = np.append(id_[1:], NONE)
            after[start + size - 1] = NONE
            self._table("bytes", pa.table({"key": key, "id": id_, "next": after}))
            query = ENCODE
        out = self.db.sql(query + WORDS.format(rows="done") + " ORDER BY d.word").to_arrow_table()
        ids, decoded = (pa.concat_arrays(out.column(c).chunks).cast(pa.large_binary()) for c in ("ids", "decoded"))
        return ids, out.column("n").to_numpy(), decoded

    def _learn(self, words: list[str]) -> None:
        done: list[tuple[pa.Array, np.ndarray, pa.Array]] = []
        rest: list[tuple[str, bytes]] = []
        order: list[str] = []
        tokens = [w for w in words if w in self.whole]
        if tokens:
            raw, ids = [w.encode() for w in tokens], [b"%d " % self.whole[w] for w in tokens]
            done.append((pa.array(ids, pa.large_binary()), np.ones(len(tokens), np.int64), pa.array(raw, pa.large_binary())))
            order += tokens
        size = 0

        def solve() -> None:
            nonlocal size
            if rest:
                done.append(self._encoded([raw for _, raw in rest]))
                order.extend(w for w, _ in rest)
            rest.clear()
            size = 0

        for word in words:
            if word in self.whole:
                continue
            raw = word.encode()
            if len(raw) > LONG:
                solve()
            rest.append((word, raw))
            size += len(raw)
            if len(rest) >= QUERY_WORDS or size >= QUERY_BYTES or len(raw) > LONG:
                solve()
        solve()
        self.at.update(zip(order, range(len(self.n), len(self.n) + len(order))))
        self.ids = pa.concat_arrays([self.ids, *[d[0] for d in done]])
        self.decoded = pa.concat_arrays([self.decoded, *[d[2] for d in done]])
        self.n = np.concatenate([self.n, *[d[1] for d in done]])
        self.met = np.concatenate([self.met, np.full(len(order), self.turn)])

    def _halve(self) -> None:
        keep = np.sort(np.argsort(self.met, kind="stable")[len(self.met) // 2 :])
        new = np.full(len(self.met), -1)
        new[keep] = np.arange(len(keep))
        self.at = {w: i for w, i in zip(self.at, new[np.fromiter(self.at.values(), np.int64)].tolist()) if i >= 0}
        self.ids, self.decoded = self.ids.take(pa.array(keep)), self.decoded.take(pa.array(keep))
        self.n, self.met = self.n[keep], self.met[keep]

    def places(self, words: list[str]) -> np.ndarray:
        """Where the cache has each word, in order."""
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.at) + len(distinct) > CACHE_WORDS:
            self._halve()
            if len(self.at) + len(distinct) > CACHE_WORDS:
                self._forget()
        self.turn += 1
        new = [w for w in distinct if w not in self.at]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.at.__getitem__, distinct), np.int64, len(distinct))
        self.met[at] = self.turn
        return at[coded.indices.to_numpy()]

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        """Bytes of lists of ids, by an aggregation ordered by position; ids beyond the vocabulary have none."""
        rows = [(t, i, token) for t, tokens in enumerate(ids) for i, token in enumerate(tokens)]
        out = [b""] * len(ids)
        if rows:
            text, place, token = (pa.array(x, pa.int64()) for x in zip(*rows))
            self._table("tokens", pa.table({"word": text, "place": place, "id": token}))
            for t, _, _, decoded in self.db.execute(WORDS.format(rows="tokens")).fetchall():
                out[t] = decoded
        return out


_codecs: dict[bytes, Codec] = {}


def codec(ranks: bytes, pattern: str) -> Codec:
    """One for each Python worker and vocabulary."""
    key = hashlib.sha256(ranks + pattern.encode()).digest()
    if key not in _codecs:
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def _joined(parts: pa.Array, at: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
    """The parts at these places, put together by text."""
    taken = parts.take(pa.array(at))
    _, offsets, data = taken.buffers()
    ends = np.frombuffer(offsets, np.int64, len(taken) + 1, taken.offset * 8)[bounds].tolist()
    whole = memoryview(data) if data is not None else memoryview(b"")
    return [whole[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _encoded(batches: Iterator[pa.RecordBatch], ranks: bytes, pattern: str, full: bool) -> Iterator[pa.RecordBatch]:
    own = codec(ranks, pattern)
    for batch in slices(batches, "text", STEP):
        texts = [own.split(t or "") for t in batch.column("text").to_pylist()]
        bounds = np.cumsum([0, *map(len, texts)])
        at = own.places([w for words in texts for w in words])
        del texts
        total = np.concatenate([[0], np.cumsum(own.n[at])])
        ids, decoded = _joined(own.ids, at, bounds), _joined(own.decoded, at, bounds)
        ids = [x[:-1] for x in ids]  # less the last blank
        columns = [batch.column("doc_id"), pa.array(total[bounds[1:]] - total[bounds[:-1]], pa.int64()), *[pa.array([hashlib.sha256(x).hexdigest() for x in column]) for column in (ids, decoded)]]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if full:
            columns.append(pa.array([np.array(bytes(x).split(), "S").astype(np.int32) for x in ids], pa.list_(pa.int32())))
            columns.append(pa.array([bytes(x).decode(errors="replace") for x in decoded]))
            names += ["ids", "decoded"]
        yield pa.RecordBatch.from_arrays(columns, names)
    give_back()


def encode(docs: DataFrame, path: str, pattern: str, full: bool = False) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_tokens, ids_sha256, decoded_sha256), a row for each row, in the rows' order.

    ``path`` has the ranks (base64 and number, a line each); the driver reads it, executors need no such file.
    ``full`` adds the ids and the decoded text.  Null texts count as empty: no tokens, digests of nothing.  Special
    tokens are ordinary text.  Repeated rows, null ids and other columns do no harm.
    """
    with open(path, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary file: under 1 MB
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if full else "")
    return no_clash(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _encoded(it, ranks.value, pattern, full), schema)


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) -> (doc_id, decoded binary); null ids count as no ids."""
    with open(path, "rb") as file:
        ranks = tokens.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.decode([x or [] for x in batch.column("ids").to_pylist()]), pa.binary())], ["doc_id", "decoded"])

    return no_clash(tokens, "doc_id", "ids").select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, decoded binary")
