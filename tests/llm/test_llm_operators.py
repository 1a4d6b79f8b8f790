"""The numbered operators against brute force, public libraries and held-out labels."""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import canonical  # noqa: F401  (the session's tables)
from recordsmith.llm import bpe, decontamination, fixity, jaccard_join, lm_scoring, nearest, quality, substring_dedup, suffix_dedup, toxicity
from recordsmith.llm.queries import ORACLES, QUERIES
from recordsmith.llm.queries_bpe import vocabulary

from .conftest import HARD, edited, prose


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, oracle, name):
    df = QUERIES[name](spark, sf_dir)
    assert canonical([r.asDict() for r in df.collect()], df.columns) == oracle(ORACLES[name])


def split(text):
    return (text or "").encode().lower().split()


# 1 ---------------------------------------------------------------------------------------------------------------


def test_lm_scoring_cases(hard, none):
    got = {r.doc_id: r for r in lm_scoring.score(hard, F.col("source") == "src3").collect()}
    assert set(got) == {d for d, _ in HARD if d is not None}
    assert got[1].n_tokens == got[2].n_tokens == 1 and got[7].n_tokens == 121 and got[18].n_tokens == 82
    assert got[7].score < got[12].score and all(np.isfinite(r.score) for r in got.values())
    assert lm_scoring.score(none, F.lit(True)).count() == 0


# 2 ---------------------------------------------------------------------------------------------------------------


def brute_components(rows, k, percent):
    ids = [d for d, _ in rows if d is not None]
    sets = {}
    for d, t in rows:
        w = split(t)
        sets[d] = set(zip(*[w[i:] for i in range(k)])) if len(w) >= k else ({tuple(w)} if w else set())
    root = {d: d for d in ids}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return {d: (len(sets[d]), root[d]) for d in ids}


def test_jaccard_join_brute_force(spark, hard, none):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(hard).collect()}
    assert got == brute_components(HARD, 3, 90)
    assert jaccard_join.near_duplicates(none).count() == 0


@pytest.mark.parametrize("boundary", [0, 15, 1 << 40])
def test_jaccard_join_groups(spark, monkeypatch, boundary):
    """Groups of near copies that chain, whichever way sets go."""
    monkeypatch.setattr(jaccard_join, "cheapest_boundary", lambda rows: boundary)
    rows = []
    for g in range(6):
        base = prose(100 + g, 20 + 25 * g)
        for c in range(8):
            now = base.split()
            for e in range(c // 2):
                now[(7 * e + c) % len(now)] = f"w{g}{e}{c % 3}"
            rows.append((len(rows), " ".join(now)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df, k, percent).collect()}
        assert got == brute_components(rows, k, percent)


@pytest.mark.parametrize("boundary", [0, 1 << 40])
def test_jaccard_join_sizes_between(spark, monkeypatch, boundary):
    """Three sets on a list, of which two link only at a size between the limits."""
    monkeypatch.setattr(jaccard_join, "cheapest_boundary", lambda rows: boundary)
    for percent, sizes in ((90, range(20, 45)), (80, range(10, 30))):
        rows = []
        for g, shared in enumerate(sizes):
            base, own = prose(3000 + g, shared + 2), iter(prose(4000 + g, 300).split())
            for more in (1, 2, 3) if percent == 90 else (1, 4, 5):
                rows.append((len(rows), " ".join([base, *[next(own) for _ in range(more)]])))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df, 3, percent).collect()}
        assert got == brute_components(rows, 3, percent)


# 3 ---------------------------------------------------------------------------------------------------------------


def test_decontamination(spark, hard, none):
    items = [(1, prose(50, 40)), (2, prose(51, 16)), (3, None), (4, ""), (5, "short item"), (6, prose(50, 40)), (None, prose(52, 30))]
    docs, want = [], {}
    for i in range(60):
        item = items[i % 2]
        n = len(item[1].split())
        k = (i // 2) % (n // 5 + 1)
        places = sorted({(11 * j + i) % n for j in range(k)})
        docs.append((i, f"{prose(200 + i, 30)} {edited(item[1], *places)} {prose(300 + i, 30)}"))
        want[i, item[0]] = len(places)
    docs += [(100, prose(400, 200)), (101, "a short item here"), (102, None), (103, items[0][1].upper())]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontamination.contaminated(df, bench).collect()}
    assert (101, 5) in got and got[103, 1] == 0 and got[103, 6] == 0
    assert all(d not in (100, 102) for d, _ in got)
    found = [p for p in want if p in got]
    assert len(found) >= 0.95 * len(want) and all(got[p] <= want[p] for p in found)
    left = {r.doc_id for r in decontamination.clean(df, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in got}
    assert decontamination.contaminated(df, bench.limit(0)).count() == 0 and decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(hard, bench).count() == 0


def test_decontamination_long_items(spark):
    """Copies with as many edits as are allowed, of items for which the walks do not reach the recall."""
    items = [(i, prose(8000 + i, n)) for i, n in enumerate((60, 80, 100, 200, 450))]
    docs, rng = [], np.random.default_rng(5)
    for i in range(100):
        w = items[i % 5][1].split()
        for p in sorted(rng.choice(len(w), len(w) // 5, replace=False).tolist(), reverse=True):
            kind = rng.integers(3)
            w[p : p + 1] = [[f"new{p}"], [], [w[p], f"more{p}"]][kind]
        around = (prose(8100 + i, 300 if i % 4 else 0), prose(8300 + i, 300 if i % 3 else 0))
        docs.append((i, f"{around[0]} {' '.join(w)} {around[1]}"))
    # too far: every fourth word
    docs += [(200 + i, edited(t, *range(0, len(t.split()), 4))) for i, t in items]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(df, bench).collect()}
    assert set(got) == {(i, i % 5) for i in range(100)}
    for (i, j), r in got.items():
        assert r.edits <= len(items[j][1].split()) // 5 and r.n_words == len(items[j][1].split())
    assert {r.doc_id for r in decontamination.clean(df, bench).collect()} == {200 + i for i in range(5)}


def test_edit_distance():
    rng = np.random.default_rng(0)
    for _ in range(100):
        a, b = rng.integers(0, 3, rng.integers(1, 6)), rng.integers(0, 3, rng.integers(1, 9))
        best = 99
        for i in range(len(b) + 1):
            for j in range(i, len(b) + 1):
                d = np.arange(j - i + 1)
                for x in a:
                    new = [d[0] + 1]
                    for m, y in enumerate(b[i:j]):
                        new.append(min(d[m] + (x != y), d[m + 1] + 1, new[-1] + 1))
                    d = new
                best = min(best, d[-1])
        assert decontamination.edit_distance(a[None].astype(np.uint64), b[None].astype(np.uint64))[0] == best


# 4 ---------------------------------------------------------------------------------------------------------------


def test_bpe_against_library(spark, hard, none):
    import tiktoken

    path, pattern = vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    more = [(90, "  two\n\n\nlines \t <|endoftext|> I'll"), (91, "日本語 🎉 ÿ\u0000"), (92, "a" * 300 + " " * 50), (93, "!!??--" * 40)]
    df = hard.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = bpe.encode(df, path, pattern, full=True).collect()
    texts = [(d, t or "") for d, t in [*HARD, *more]]
    want = sorted((str(d), library.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for d, t in texts)
    assert sorted((str(r.doc_id), r.ids, r.decoded_sha256) for r in rows) == want
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() for r in rows)
    back = bpe.decode(bpe.encode(df, path, pattern, full=True).select("doc_id", "ids"), path, pattern)
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in back.collect()) == sorted((str(d), t) for d, t in texts)
    assert bpe.encode(none, path, pattern).count() == 0


# 5 ---------------------------------------------------------------------------------------------------------------


def brute_repeats(rows, length):
    seen, out = set(), {}
    for d, t in sorted({(d, t or "") for d, t in rows if d is not None}):
        raw = t.encode()
        cover = np.zeros(len(raw) + 1, int)
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in seen:
                cover[s] += 1
                cover[s + length] -= 1
            seen.add(raw[s : s + length])
        gone = np.cumsum(cover)[: len(raw)] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d] = (len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    return out


def test_suffix_dedup_brute_force(hard, none):
    rows = suffix_dedup.remove_repeats(hard).collect()
    assert len(rows) == len([d for d, _ in HARD if d is not None])
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute_repeats(HARD, 100)
    assert suffix_dedup.remove_repeats(none).count() == 0
    for r in suffix_dedup.remove_repeats(hard, as_text=True).collect():
        r.kept_text.encode()


def test_suffix_dedup_hot_line(spark):
    """A line between two others that more texts hold than one block takes."""
    line = prose(9000, 30)
    rows = [(i, f"{prose(20000 + i % 1700, 12)}\n{line}\n{prose(30000 + i % 1900, 12)}") for i in range(2 * suffix_dedup.HOT)] + [(1 << 62, line)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_repeats(rows, 100)


def test_open_intervals():
    rng = np.random.default_rng(2)
    for _ in range(20):
        contexts = [bytes(rng.integers(97, 99, rng.integers(6, 25)).astype(np.uint8)) for _ in range(12)]
        windows = np.array([len(c) - 5 for c in contexts])
        seen, want = set(), []
        for c in contexts:
            for s in range(len(c) - 5):
                want.append(c[s : s + 6] in seen)
                seen.add(c[s : s + 6])
        assert suffix_dedup.repeated_windows(contexts, windows, 6).tolist() == want


# 6 ---------------------------------------------------------------------------------------------------------------


def test_nearest_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    bad = spark.createDataFrame([(100_000, None, 0), (100_100, [0.0] * 64, 0), (100_200, [1.0] * 63 + [float("nan")], 0), (100_300, [1.0, 2.0], 0), (None, [1.0] * 64, 0)], table.schema)
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got: dict = {}
    for r in nearest.nearest(table.unionByName(bad), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids, points = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((points - points[ids == q][0]) ** 2).sum(1))
        far[ids == q] = np.inf
        best = ids[np.lexsort((ids, far))[:10]]
        hits, total = hits + len({v for v, _ in got[q]} & set(best)), total + len(best)
        assert all(abs(s - far[ids == v][0]) < 1e-9 for v, s in got[q]) and got[q] == sorted(got[q], key=lambda x: (x[1], x[0]))
    assert hits / total >= 0.9 and set(got) == set(ids[ids % 100 == 0])
    assert nearest.nearest(table.limit(0), F.lit(True)).count() == 0


def test_nearest_cases(spark):
    """Ties, repeated rows, a clashing column, queries among small leaves and one whose id most rows share."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 0.01, 8).tolist(), "x") for i in range(3000)] + [(5000 + i, (rng.normal(0, 1, 8) * 100).tolist(), "x") for i in range(40)]
    rows += [(6000, [9000.0] * 8, "a"), (6001, [9001.0] * 8, "a"), (6002, [9001.0] * 8, "a"), (100, rng.normal(0, 1, 8).tolist(), "again"), (200, rows[200][1], "again")]
    rows += [(7000, [500.0 + i] * 8, "own") for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").withColumn("rank", F.lit("clash"))
    got: dict = {}
    for r in nearest.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    ids, points = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    hits = total = 0
    for q in np.unique(ids[ids % 100 == 0]):
        vectors = np.unique(points[ids == q], axis=0)
        assert len(got[q]) == 10 * len(vectors) and {rank for rank, _, _ in got[q]} == set(range(1, 11))
        for v in vectors:
            far = np.sqrt(((points - v) ** 2).sum(1))
            far[ids == q] = np.inf
            best = sorted(zip(far, ids))[:10]
            hits, total = hits + len({(round(s, 9), i) for _, s, i in got[q]} & {(round(s, 9), i) for s, i in best}), total + len({(round(s, 9), i) for s, i in best})
    assert hits / total >= 0.9
    assert [i for _, _, i in sorted(got[6000])[:2]] == [6001, 6002]
    few = nearest.nearest(df.where("vec_id >= 6000 and vec_id < 7000"), F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in few) == [(6000, 1, 6001), (6000, 2, 6002)]


def test_nearest_copies_no_query(spark, monkeypatch):
    """Where queries visit many leaves, nothing that is written has a row for each leaf that a query visits."""
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(0, 1, 16).tolist()) for i in range(3000)]
    written, cut = [], nearest.cut
    monkeypatch.setattr(nearest, "cut", lambda df: written.append(cut(df)) or written[-1])
    monkeypatch.setattr(nearest, "release", lambda *tables: None, raising=False)
    assert nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True)).count() == 30_000
    assert max(df.count() for df in written) <= 30_000


def test_nearest_best():
    """Against brute force: ties, ids that repeat, own ids, far and near vectors, squares that pass a double, tiles in any order."""
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.normal(0, 1, (300, 5)).round(1), rng.normal(0, 1, (40, 5)) * 1e-200, 1e8 + rng.normal(0, 1e-6, (40, 5)), rng.normal(0, 1, (20, 5)) * 1e160, rng.normal(0, 1, (20, 5)) * 1e100])
    points, ids = np.concatenate([points, points[:100]]), rng.integers(0, 400, 520)
    best = nearest.Best(ids[::3], points[::3], 7)
    for at in np.array_split(rng.permutation(520), 9):
        some = rng.permutation(len(best.ids))
        for which in np.array_split(some, 2):
            best.meet(ids[at], points[at], 4, which)
    query, found, far, notes = best.rows()
    assert (notes == 4).all()
    with np.errstate(over="ignore"):
        for i, (own, point) in enumerate(zip(ids[::3], points[::3])):
            away = np.sqrt(((points - point) ** 2).sum(1))
            want = sorted((d, v) for d, v in zip(away, ids) if v != own and np.isfinite(d))[:7]
            assert list(zip(far[query == i], found[query == i])) == want


# 7, 9 ------------------------------------------------------------------------------------------------------------


def held(rows):
    return np.array([zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows])


def held_out_rows(spark, sf_dir, module, label):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = module.score_documents(docs, module.train(docs, labels))
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert held(rows).all()
    return np.array([r.score for r in rows]), np.array([r.predicted for r in rows]), np.array([r[label] for r in rows])


def test_quality_held_out(spark, sf_dir):
    _, predicted, y = held_out_rows(spark, sf_dir, quality, "quality")
    assert (predicted == y).mean() >= 0.9


def test_toxicity_held_out(spark, sf_dir):
    """Two fifths of the labels of these tables are on texts without any rude word, so that recall cannot near 1."""
    score, predicted, y = held_out_rows(spark, sf_dir, toxicity, "toxic")
    assert (predicted == y).mean() >= 0.9 and predicted[y == 1].mean() >= 0.5 and predicted[y == 0].mean() <= 0.02
    assert (score[y == 1][:, None] > score[y == 0][None]).mean() >= 0.9


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_cases(hard, none, module):
    model = module.fit(pa.array([prose(i, 30) for i in range(40)] + [prose(i, 30).upper() + "!!" for i in range(40)]), [0] * 40 + [1] * 40)
    rows = module.score_documents(hard, model).collect()
    assert len(rows) == len(HARD) and all(0 <= r.score <= 1 for r in rows)
    blank = {r.score for r in rows if r.doc_id in (1, 2)}
    assert len(blank) == 1
    assert module.score_documents(none, model).count() == 0
    assert {round(r.score, 6) for r in module.score_documents(hard, module.fit(pa.array(["a"]), [1])).collect()} == {0.5}


def test_toxicity_misspelt():
    clean = [prose(i, 40) for i in range(300)]
    rude = [edited(prose(1000 + i, 40), 5).replace("edit5", "horridword") for i in range(300)]
    model = toxicity.fit(pa.array(clean + rude), [0] * 300 + [1] * 300)
    scores = toxicity.score_texts(pa.array([prose(5000, 40), prose(5000, 20) + " horridword", prose(5000, 20) + " horridwurd horidword"]), model)
    assert scores[1] > 0.7 > scores[0] and scores[2] > scores[0]


# 8 ---------------------------------------------------------------------------------------------------------------


def test_fixity(spark):
    mine = [(i, f"record {i}") for i in range(5000)] + [(-3, "before"), (7, "record 7"), (None, "none"), (9, None)]
    theirs = [(i, f"record {i}" if i not in (16, 4097) else "other") for i in range(5000) if i != 300] + [(-3, "before"), (7, "record 7"), (6000, "extra"), (9, None)]
    a, b = spark.createDataFrame(mine, "page_id long, record string"), spark.createDataFrame(theirs, "page_id long, record string")
    assert {(r.page_id, r.status) for r in fixity.audit(a, b).collect()} == {(16, "changed"), (4097, "changed"), (300, "lost"), (6000, "extra")}
    assert fixity.audit(a, a).count() == 0 and fixity.audit(a.limit(0), b.limit(0)).count() == 0
    lost = next(r for r in fixity.audit(a, b).collect() if r.page_id == 300)
    assert lost.end_offset - lost.start_offset == len("record 300")


def test_fixity_repeats(spark):
    """Copies of one record that differ only in how often each stands there."""
    a, b = ([(3, t) for t in copies] + [(4, "whole")] for copies in (["one", "one", "two"], ["two", "one", "two"]))
    a, b = (spark.createDataFrame(rows, "page_id long, record string") for rows in (a, b))
    assert [(r.page_id, r.status) for r in fixity.audit(a, b).collect()] == [(3, "changed")]
    assert fixity.audit(a, a.orderBy(F.desc("record"))).count() == 0


# 10 --------------------------------------------------------------------------------------------------------------


def test_substring_dedup(spark, hard, none):
    rows = [(i, prose(600 + i, 150)) for i in range(30)]
    shared = prose(999, 70)
    for i in range(0, 10, 2):
        rows[i] = (i, f"{prose(700 + i, 40)} {shared} {prose(800 + i, 40)}")
    rows += [(40, edited(rows[3][1], 75)), (41, rows[5][1]), (42, None), (43, ""), (44, prose(1, 49)), (45, prose(1, 49))]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    docs = dict(rows)
    assert {r.doc_id for r in got} == {2, 4, 6, 8, 40, 41} and {r.partner_id for r in got} <= {0, 2, 4, 6, 3, 5}
    for r in got:
        a, b = docs[r.doc_id].split()[r.start_word : r.end_word], docs[r.partner_id].split()[r.partner_start : r.partner_end]
        x, y = set(zip(*[a[i:] for i in range(5)])), set(zip(*[b[i:] for i in range(5)]))
        assert len(a) >= 50 and len(x & y) / len(x | y) >= 0.8
    assert substring_dedup.repeated_passages(none).count() == 0
    found = {r.doc_id for r in substring_dedup.repeated_passages(hard).collect()}
    assert {8, 9, 10, 12, 16} <= found and not found & {None, 1, 2, 3, 4, 7, 11, 17, 18, 20}


def test_pairs_of_classes():
    """Under a key every two documents meet by their classes: as equals of one's first document, or their classes do."""
    rng = np.random.default_rng(12)
    for _ in range(40):
        rows = np.unique(np.stack([rng.integers(0, 3, 60), rng.integers(0, 6, 60), rng.integers(0, 9, 60)], axis=1), axis=0)
        key, content, doc = rows[:, 0].astype(np.uint64), rows[:, 1].astype(np.uint64), rows[:, 2].astype(np.int64)
        met, own = set(), {}
        for later, earlier in substring_dedup.pairs_of_classes(key, doc, content):
            assert (key[later] == key[earlier]).all() and (doc[later] != doc[earlier]).all()
            met |= {(int(key[i]), frozenset([(int(content[i]), int(doc[i])), (int(content[j]), int(doc[j]))])) for i, j in zip(later, earlier)}
        for k, c, d in rows.tolist():
            own.setdefault((k, c), []).append(d)
        for (k, c), docs in own.items():
            assert all((k, frozenset([(c, min(docs)), (c, d)])) in met for d in docs if d != min(docs))
            for (k2, c2), others in own.items():
                if k2 == k and c2 != c and set(docs) | set(others) != {docs[0]}:
                    assert any((k, frozenset([(c, x), (c2, y)])) in met for x in docs for y in others)


def test_substring_dedup_recall(spark):
    """Planted passages, copied with up to three of a hundred words edited, in pairs and groups, some beside a line that all
    hold; held to the brute-force similarity of each plant."""
    rng, rows, plants = np.random.default_rng(8), [], []
    line = prose(77, 40)
    for g in range(60):
        passage = prose(50_000 + g, int(rng.integers(60, 160)))
        for c in range(12 if g % 10 == 0 else 2):
            w = passage.split()
            for p in rng.choice(len(w), int(len(w) * 0.03 * (g % 4 if c else 0) / 3), replace=False):
                w[p] = f"own{g}x{c}x{p}"
            before = prose(60_000 + len(rows), int(rng.integers(0, 80))).split() + (line.split() if g % 3 == 0 else [])
            rows.append((len(rows), " ".join([*before, *w, *prose(70_000 + len(rows), int(rng.integers(0, 80))).split()])))
            if c:
                plants.append((len(rows) - 1, len(before), len(before) + len(w)))
    clean = len(rows)
    rows += [(clean + i, prose(80_000 + i, 120)) for i in range(60)]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    docs, cover = {d: t.split() for d, t in rows}, {d: np.zeros(len(t.split()), bool) for d, t in rows}
    shingled = lambda w: set(zip(*[w[i:] for i in range(5)]))
    for r in got:
        x, y = shingled(docs[r.doc_id][r.start_word : r.end_word]), shingled(docs[r.partner_id][r.partner_start : r.partner_end])
        assert r.partner_id < r.doc_id and r.end_word - r.start_word >= 50 and abs(r.similarity - len(x & y) / len(x | y)) < 1e-9 and r.similarity >= 0.8
        cover[r.doc_id][r.start_word : r.end_word] = True
    found = [cover[d][a:b].mean() >= 0.8 for d, a, b in plants]
    assert np.mean(found) >= 0.95 and not any(cover[clean + i].any() for i in range(60))


def test_pairs_with_pivots():
    """Under a key each class meets that of most documents and that of the earliest one; the pairs left over are those of which
    the later window is not covered or the groups differ."""
    rng = np.random.default_rng(13)
    for _ in range(40):
        rows = np.unique(np.stack([rng.integers(0, 3, 90), rng.integers(0, 12, 90) ** 2 // 12, rng.integers(0, 15, 90)], axis=1), axis=0)
        key, content, doc = rows[:, 0].astype(np.uint64), rows[:, 1].astype(np.uint64), rows[:, 2].astype(np.int64)
        named = lambda i, j: (int(key[i]), int(content[i]), int(doc[i]), int(content[j]), int(doc[j]))
        met = {named(i, j) for x, y in substring_dedup.pairs_with_pivots(key, doc, content) for i, j in zip(x, y)}
        every = {named(i, j) for x, y in substring_dedup.pairs_of_classes(key, doc, content) for i, j in zip(x, y)}
        classes = {k: {c: sorted(doc[(key == k) & (content == c)].tolist()) for c in set(content[key == k].tolist())} for k in set(key.tolist())}
        for k, own in classes.items():
            most = max(own, key=lambda c: (len(own[c]), -own[c][0]))
            for p in (most, min(own, key=lambda c: own[c][0])):
                for c, docs in own.items():
                    assert all((k, c, d, c, docs[0]) in met for d in docs[1:])
                    if c != p and set(docs) | set(own[p]) != {docs[0]}:
                        assert any((k, *x) in met for d in docs for e in own[p] for x in ((c, d, p, e), (p, e, c, d)))
        assert all(d > e for _, _, d, _, e in met) and len(met) <= 3 * len(rows)
        covered, group = rng.random(len(key)) < 0.7, rng.integers(0, 2, 15)[doc]
        left = {named(i, j) for x, y in substring_dedup.pairs_of_classes(key, doc, content, covered, group) for i, j in zip(x, y)}
        of = {(int(k), int(c), int(d)): (bool(v), int(g)) for k, c, d, v, g in zip(key, content, doc, covered, group)}
        apart = {(k, c, d, c2, e) for k, c, d, c2, e in every if c != c2 and (not of[k, c, d][0] or of[k, c, d][1] != of[k, c2, e][1])}
        assert apart <= left and all(not of[k, c, d][0] or of[k, c, d][1] != of[k, c2, e][1] for k, c, d, c2, e in left)


def test_substring_dedup_edited_copies(spark):
    """Copies of a passage, each edited otherwise, make rows in proportion to their number; pairs that share their own edits
    and are similar to no others are linked."""
    passage, rows = prose(95, 150).split(), []
    for i in range(160):
        w = list(passage)
        w[(i * 37) % 150] = f"own{i}"
        rows.append((i, f"{prose(21_000 + i, 40)} {' '.join(w)} {prose(22_000 + i, 40)}"))
    for i in range(160, 180):
        w = list(passage)
        for p in range(i // 2 % 10, 150, 11):
            w[p] = f"pair{i // 2}x{p}"
        w[75 + i % 2] = f"own{i}"
        rows.append((i, f"{prose(21_000 + i, 40)} {' '.join(w)} {prose(22_000 + i, 40)}"))
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) < 12 * len(rows)
    cover, of = np.zeros((180, 230), bool), list(range(180))
    for r in got:
        cover[r.doc_id, r.start_word : r.end_word] = True
        x, y = sorted((of[r.doc_id], of[r.partner_id]))
        of = [x if c == y else c for c in of]
    assert cover[1:160, 40:190].mean(axis=1).min() >= 0.8 and set(of[:160]) == {0}
    assert [of[i] for i in range(160, 180)] == [i // 2 * 2 for i in range(160, 180)]


def test_possible_candidates():
    """What is left out before the comparison has no similar part there."""
    rng = np.random.default_rng(14)
    for most in (40, 400):
        text = rng.integers(0, most, 900).astype(np.uint32)
        mine, low, high = [], [], []
        for i in range(120):
            a = int(rng.integers(0, 800))
            low.append(a)
            high.append(int(rng.integers(a + 1, 901)))
            part = np.concatenate([text[a : a + int(rng.integers(1, 150))], rng.integers(0, most, int(rng.integers(0, 40))).astype(np.uint32)])
            mine.append(np.where(rng.random(len(part)) < rng.random() * 0.3, rng.integers(0, 1 << 31, len(part)), part).astype(np.uint32))
        own = np.concatenate([[0], np.cumsum([len(x) for x in mine])])
        low, high = np.array(low), np.array(high)
        table = np.sort(text.astype(np.uint64) << np.uint64(32) | np.arange(len(text), dtype=np.uint64))
        keep = substring_dedup.possible(np.concatenate(mine), own, low, high, table, 46, 80)
        partner = np.concatenate([[0], np.cumsum(high - low)])
        wholes, rest = substring_dedup.compared(np.concatenate(mine), own, np.concatenate([text[a:b] for a, b in zip(low, high)]), partner, 46, 80)
        found = set(wholes[:, 0].tolist()) | set(rest.tolist())
        assert found <= set(np.flatnonzero(keep).tolist()) and 0 < len(found) and not keep.all()


def _pairs_met(texts: list[str], common: int) -> set[tuple[int, int]]:
    grams, bounds = substring_dedup._grams(pa.array(texts))
    values, counts = np.unique(grams, return_counts=True)
    rows = [np.concatenate(x) for x in zip(*substring_dedup.keyed(grams, bounds, 46, 80, np.isin(grams, values[counts > common])))]
    doc = np.searchsorted(bounds, rows[1], "right") - 1
    order = np.lexsort((rows[1], doc, rows[2], rows[0]))
    met = substring_dedup.pairs_of_classes(rows[0][order], doc[order], rows[2][order])
    return {(int(a), int(b)) for later, earlier in met for a, b in zip(doc[order][later], doc[order][earlier])}


def test_substring_dedup_common_lines(spark):
    """Texts that share a line or a passage, word for word, meet the first of them and no others, but those that go on alike do;
    the classes of linked texts are those of all pairs."""
    line, passage, texts = prose(91, 18), prose(92, 70), []
    for i in range(300):
        texts.append(f"{prose(5000 + i, 70)} {line} {prose(9000 + i % 290, 60)} {passage if i % 2 else ''} {prose(7000 + i, 70)}")
    for i in range(40):
        w = passage.split()
        w[i] = f"own{i}"
        texts.append(f"{prose(11_000 + i, 50)} {' '.join(w)} {prose(12_000 + i, 50)}")
    met = _pairs_met(texts, 32)
    assert len(met) < 2500 < 20_000 < len(_pairs_met(texts, 1 << 40)) and {(290 + i, i) for i in range(10)} <= met
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def classes(common: int) -> list[int]:
        of = list(range(len(texts)))
        for r in substring_dedup.repeated_passages(docs, common=common).select("doc_id", "partner_id").distinct().collect():
            x, y = sorted((of[r.doc_id], of[r.partner_id]))
            of = [x if c == y else c for c in of]
        return of

    assert classes(32) == classes(1 << 40)


def test_similar_passages_repeated_lines():
    """The passage's opening, its closing or both stand elsewhere in the partner too."""
    rng = np.random.default_rng(3)
    fresh = lambda n: rng.integers(1 << 62, size=n).astype(np.uint64)
    for n, opens, closes in ((56, 1, 0), (56, 0, 1), (56, 1, 1), (90, 3, 3)):
        copied = fresh(n)
        theirs = np.concatenate([copied[:opens], fresh(39), copied[n - closes :], fresh(5), copied, fresh(20), copied[:opens], fresh(9)])
        found = list(substring_dedup.similar_passages(copied, theirs, 46, 80))
        assert len(found) == 1 and found[0][:2] == (0, n)
        for a, b, k, m, similar in found:
            x, y = set(copied[a:b].tolist()), set(theirs[k:m].tolist())
            assert m - k >= 46 and similar == len(x & y) / len(x | y) >= 0.9
    # two copied passages in one stretch, in the other order and far from each other
    one, two = fresh(60), fresh(60)
    found = list(substring_dedup.similar_passages(np.concatenate([one, two]), np.concatenate([two, fresh(80), one]), 46, 80))
    covered = np.zeros(120, bool)
    for a, b, _, _, similar in found:
        covered[a:b] = True
        assert similar >= 0.8
    assert covered.sum() >= 100
    assert not list(substring_dedup.similar_passages(fresh(60), fresh(60), 46, 80))


def test_best_partner():
    rng = np.random.default_rng(4)
    for _ in range(50):
        theirs, own = rng.integers(0, 12, 40), rng.integers(0, 12, 10)
        k, m, surplus = substring_dedup.best_partner(own, theirs, substring_dedup._before(theirs), 5, 80, {})
        gain = lambda x, y: 180 * len(x & y) - 80 * (len(x) + len(y))
        x, size = set(own.tolist()), len(set(own.tolist()))
        lengths = {max(5, round(size * c / 100)) for c in (100, 90, 110, 80, 125)}
        assert surplus == gain(x, set(theirs[k:m].tolist())) == max(gain(x, set(theirs[i : i + n].tolist())) for n in lengths for i in range(41 - n))


# pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir, hard, none):
    import corpus_pipeline
    from recordsmith.llm import pipeline_stages as stages

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = hard.select(columns)
    kept = stages.one_of_each_group(spark, docs, sf_dir)
    want = {d for d, (_, c) in brute_components(HARD, 5, 80).items() if c == d}
    assert {r.doc_id for r in kept.collect()} == want | {None} and kept.columns == columns
    cut = {r.doc_id: r for r in stages.cut_repeats(spark, docs.dropDuplicates(["doc_id"]), sf_dir).collect()}
    brute = brute_repeats(HARD, 100)
    assert cut[8].text == "" and cut[1].text is None and cut[7].text == dict(HARD)[7]
    assert len(cut[12].text.encode()) == brute[12][0] - brute[12][1] and cut[12].n_chars == len(cut[12].text)
    assert {r.doc_id for r in stages.reject_toxic(spark, docs, sf_dir).collect()} <= {d for d, _ in HARD}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none.select(columns), sf_dir).columns == columns
    result = corpus_pipeline.run(spark, sf_dir)
    assert result.count() > 0 and set(result.columns) >= {"doc_id", "n_tokens"}


def test_pipeline_stages_with_clashing_columns(spark, sf_dir, hard):
    """Columns with names that stages use inside, a map, and a name with a dot keep their values; so do rows that repeat an id."""
    from recordsmith.llm import pipeline_stages as stages

    more = {"text_hash": F.lit("mine"), "kept_text": F.lit("own"), "_place": F.lit(7), "score": F.lit(1.5), "component_id": F.col("doc_id"), "tags": F.create_map(F.lit("k"), F.col("doc_id")), "a.b": F.lit("dot"), "n_removed": F.lit(-1)}
    plain = hard.select("doc_id", "text", "lang", "source", "n_chars")
    docs = plain.select("*", *[c.alias(name) for name, c in more.items()])
    for stage in (stages.reject_toxic, stages.one_of_each_group, stages.cut_repeats, stages.drop_contaminated):
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all((r.text_hash, r.kept_text, r._place, r.score, r["a.b"], r.n_removed) == ("mine", "own", 7, 1.5, "dot", -1) and r.component_id == r.doc_id == (r.tags or {}).get("k") for r in rows)
        as_text = lambda rows: sorted(str(tuple(r)[:5]) for r in rows)
        assert as_text(rows) == as_text(stage(spark, plain, sf_dir).collect())
