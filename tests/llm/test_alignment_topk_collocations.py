"""Alignment of tokenizers, exact top-k search and collocations against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordsmith.llm import alignment, collocations, topk
from recordsmith.llm.queries_alignment import QUERIES, vocabularies

from .conftest import HARD, prose

# 11 --------------------------------------------------------------------------------------------------------------


def brute_alignment(rows, both):
    known, counts = [], Counter()
    for doc, text in rows:
        a, b = (both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)) if text else ([], [])
        want = (" " + (text or "")).encode()
        if not text or b"".join(both.a_bytes[i] for i in a) != want or b"".join(both.b_bytes[i] for i in b) != want:
            known.append((doc, None))
            continue
        ends_a, ends_b = (np.cumsum([len(of[i]) for i in x]).tolist() for of, x in ((both.a_bytes, a), (both.b_bytes, b)))
        groups, links, i, j = [], [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(cut) + 1, ends_b.index(cut) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            start = lambda ends, k: ends[k - 1] if k else 0
            links += [(a[x], b[y]) for x in range(i, p) for y in range(j, q) if start(ends_a, x) < ends_b[y] and start(ends_b, y) < ends_a[x]]
            i, j = p, q
        counts.update(set(links))
        known.append((doc, (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(n, best.get(a, 0))
    of = lambda k: (k[0], k[1], k[2], len(k[3]), sum(counts[x] == best[x[0]] for x in k[3]), sum(counts[x] for x in k[3]), k[4])
    return sorted(((doc, *of(k)) if k else (doc, 0, 0, 0, 0, 0, 0, "") for doc, k in known), key=str)


ODD = [
    (30, "  two spaces\tand a tab \n\n line"), (31, "a b c d e\u0085f"), (32, "日本語の文章 と 空白"), (33, "marks ▁ of ▁piece"), (34, "<|endoftext|> and <s> </s> <0x0A> <unk>"), (35, "🙂🙃 emoji 👩‍👩‍👧 joined"),
    (36, "it's we're I'll they've"), (37, "x" * 3000 + " " + "ab" * 900), (38, " "), (39, "é ö combining ​ zero"), (40, "12 345 6789 1 2"), (41, "a.b,c;d e.\nF g\n\nh\n i | j\n.k \nl's. m'n."), (42, "\nstart. end\n"), (43, ".lead \n\n"), (None, "it's we're"),
]


@pytest.mark.parametrize("whole", [False, True])
def test_alignment_equals_brute_force(spark, hard, none, monkeypatch, whole):
    both = alignment.tokenizers(*vocabularies())
    assert alignment.separable(*vocabularies())
    monkeypatch.setattr(alignment, "HEAD", 20)  # so that segments are joined too
    if whole:
        monkeypatch.setattr(alignment, "separable", lambda *_: False)
    docs = hard.unionByName(spark.createDataFrame([(d, t, "en", "s", 1, 1, "x", "y") for d, t in ODD], hard.schema)).withColumnRenamed("keys", "segment").withColumnRenamed("node", "row")
    got = alignment.align(docs, *vocabularies())
    assert sorted(map(tuple, got.collect()), key=str) == brute_alignment(HARD + ODD, both)
    assert alignment.align(none, *vocabularies()).count() == 0


def test_alignment_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op11_tokenizer_alignment"](spark, sf_dir)
    assert sorted(map(tuple, got.collect()), key=str) == brute_alignment(map(tuple, rows), alignment.tokenizers(*vocabularies()))


# 12 --------------------------------------------------------------------------------------------------------------


def brute_top(rows, k):
    whole = []
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            whole.append((i, [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v]))
    out = set()
    for q, v in {(i, tuple(v)) for i, v in whole if i % 5 == 0}:
        near = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v)))[:k]
        out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(near)}
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_SHARD_ROWS", 40)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)] + [(i, [0.25] * 6) for i in range(300, 420)]  # a large group of equal vectors
    rows += [(420, None), (421, []), (422, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (423, [float("nan")] * 6), (424, [float("inf")] * 6), (425, [0.0] * 6), (430, [1e6] * 6), (435, [1.0, 2.0]), (436, [3.0, 1.0]), (None, [9.0] * 6), (300, [0.25] * 6), (5, [2.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, shard int, tree string").repartition(5)
    got = topk.top_k(df, F.col("vec_id") % 5 == 0)
    assert {tuple(r)[:4] for r in got.collect()} == brute_top(rows, 10)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0 and topk.top_k(df, F.lit(False)).count() == 0


def test_ball_tree_opens_few_nodes_and_is_exact():
    rng = np.random.default_rng(5)
    rows = np.floor(1024 * (rng.normal(size=(4000, 8)) * 0.05 + rng.normal(size=(40, 8))[rng.integers(0, 40, 4000)])).astype(np.int64)
    tree = topk.BallTree.load(topk.BallTree.build(np.arange(4000), rows).dump())
    seen, plain = [], topk.inner
    for q in range(0, 4000, 400):
        topk.inner = lambda r, v: seen.append(len(r)) or plain(r, v)  # noqa: B023
        try:
            got = tree.search(q, rows[q], 10, None)
        finally:
            topk.inner = plain
        scores = rows @ rows[q]
        assert got == sorted([(int(s), i) for i, s in enumerate(scores) if i != q], key=lambda x: (-x[0], x[1]))[:10]
        assert tree.search(q, rows[q], 10, got[4][0]) == [x for x in got if x[0] >= got[4][0]] + [x for x in tree.search(q, rows[q], 10, got[4][0]) if x not in got]
    assert sum(seen) < 0.5 * 10 * 4000


def test_inner_products_past_64_bits():
    rows, query = np.array([[1 << 62, 1 << 62], [-(1 << 62), 3]], np.int64), np.array([1 << 62, 5], np.int64)
    assert topk.inner(rows, query).tolist() == [(1 << 124) + 5 * (1 << 62), -(1 << 124) + 15]


# 13 --------------------------------------------------------------------------------------------------------------


def brute_collocations(rows, depth, least, limit):
    import re

    counts, total = Counter(), Counter()
    for text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(w)
            counts.update((lang or "und", tuple(w[i : i + k])) for k in range(1, depth + 1) for i in range(len(w) - k + 1))
    known = {p: n for p, n in counts.items() if len(p[1]) > 1 and n >= least}
    inside = {(lang, p[i : i + k]) for (lang, p), n in known.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if known[lang, p[i : i + k]] == n}
    out = []
    for (lang, p), a in known.items():
        if (lang, p) not in inside:
            n = total[lang]
            score, _, left, right = min((1000 * a * n // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
            out.append((lang, -score, -a, " ".join(p).encode(), left, right, n))
    found = []
    for name in {x[0] for x in out}:
        for rank, (lang, score, a, phrase, left, right, n) in enumerate(sorted(x for x in out if x[0] == name)[:limit]):
            found.append((lang, rank + 1, phrase.decode(), -a, left, right, n, -score))
    return sorted(found)


@pytest.mark.parametrize(("least", "limit", "held"), [(3, 2000, 1 << 20), (2, 7, 50), (300, 5, 1 << 20)])
def test_collocations_equal_brute_force(spark, hard, none, monkeypatch, least, limit, held):
    monkeypatch.setattr(collocations, "WORDS_HELD", held)
    pick = random.Random(9)
    rows = [(" ".join(pick.choices(["a", "B", "cé", "d.", "e", "of the", "x\ty", "\n", "日本", "É"], [9, 5, 5, 1, 3, 6, 2, 1, 1, 1], k=pick.randrange(90))), pick.choice(["en", None, "fr", "und"])) for _ in range(60)]
    rows += [(None, "en"), ("", "en"), ("one two three four five six " * 300, "xx"), (prose(4, 400), "yy"), ("z " * 500, "zz"), ("Ab " * 90, None)]
    rows += [(t, "en") for _, t in HARD]
    df = spark.createDataFrame([(t, lang, 1, "k") for t, lang in rows], "text string, lang string, word int, key string").repartition(4)
    got = collocations.collocations(df, 5, least, limit)
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, 5, least, limit)
    assert collocations.collocations(none).count() == 0


def test_scores_past_64_bits(spark):
    a, n, left, right = 4 * 10**11, 9 * 10**15, 5 * 10**11, 7 * 10**11
    got = spark.range(1).select(collocations._score(F.lit(a), F.lit(n), F.lit(left), F.lit(right)).alias("s")).first().s
    assert got == 1000 * a * n // (left * right)


# 7, 9, 10: what the other tests leave out --------------------------------------------------------------------------


def test_substring_dedup_of_two_texts_under_one_id(spark):
    from recordsmith.llm import substring_dedup

    shared, other = prose(50, 60), prose(51, 70)
    rows = [(1, prose(52, 30) + " " + shared), (1, other), (2, shared + " " + prose(53, 20)), (3, prose(54, 10) + " " + other), (4, prose(55, 90))]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.partner_id) for r in got} == {(2, 1), (3, 1)}
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for r in got:
        mine, theirs = ([grams(t.split()[a:b]) for d, t in rows if d == i] for i, a, b in ((r.doc_id, r.start_word, r.end_word), (r.partner_id, r.partner_start, r.partner_end)))
        assert max(len(x & y) / max(len(x | y), 1) for x in mine for y in theirs) >= 0.8


def test_quality_fit_separates_bags():
    """Bags that differ in their mean are told apart after the fit."""
    from recordsmith.llm import quality

    rng = np.random.default_rng(3)
    bags = [rng.normal(size=(rng.integers(1, 6), quality.FEATURES)) + y * 0.5 for y in (0, 1) * 20]
    model = quality.fit_bags(bags, [0, 1] * 20)
    each = np.array([len(b) for b in bags])
    z = quality._forward((np.concatenate(bags) - model["mean"]) / model["spread"], each, model)[5]
    assert (z[1::2] > 0).mean() > 0.9 and (z[::2] < 0).mean() > 0.9


def test_quality_sample_is_bounded_by_passages(spark, monkeypatch):
    from recordsmith.llm import quality

    docs = spark.createDataFrame([(i, f"{'good fine' if i % 2 else 'bad ###'} " * (2000 if i == 7 else 40)) for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    seen, plain = [], quality.fit_bags
    monkeypatch.setattr(quality, "fit_bags", lambda bags, y: seen.append((len(bags), max(map(len, bags)))) or plain(bags, y))
    quality.train(docs, labels)
    monkeypatch.setattr(quality, "FIT_PASSAGES", 8)
    quality.train(docs, labels)
    assert seen[0][0] > 30 and seen[1][0] < seen[0][0] and seen[1][0] >= 2


def test_long_texts(spark):
    """Texts of megabytes with and without blanks."""
    long = [(1, prose(60, 200_000)), (2, "x" * 300_000), (3, "ab " * 500_000), (4, "short one")]
    df = spark.createDataFrame([(d, t, "en") for d, t in long], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in alignment.align(df, *vocabularies()).collect()}
    assert got[3].n_groups == 500_001 and got[2].n_links >= got[2].n_a > 0 and all(len(got[i].groups_sha256) == 64 for i in range(1, 5))
    top = {r.phrase: r.a for r in collocations.collocations(df).collect()}
    assert top["ab ab ab ab ab"] == 500_000 - 4


def test_fixity_of_long_records_and_clashing_columns(spark):
    """Ranges in nodes: a lost record changes the nodes above it only; records of a megabyte; columns with names of the audit's own."""
    from recordsmith.llm import fixity

    rows = spark.range(600).select((F.col("id") * 3).alias("page_id"), F.concat(F.lit("r"), F.col("id")).alias("record"), F.lit(1).alias("slot"), F.lit("h").alias("hash"), F.lit("d").alias("digest"))
    rows = rows.withColumn("record", F.when(F.col("page_id") == 30, F.repeat(F.lit("z"), 1_000_000)).otherwise(F.col("record")))
    other = rows.where("page_id <> 9").withColumn("record", F.when(F.col("page_id") == 30, F.concat(F.repeat(F.lit("z"), 999_999), F.lit("y"))).otherwise(F.col("record")))
    got = {r.page_id: r for r in fixity.audit(rows, other).collect()}
    assert {k: r.status for k, r in got.items()} == {9: "lost", 30: "changed"} and got[30].end_offset - got[30].start_offset == 1_000_000
    mine, theirs = (fixity.tree(fixity.leaves(r), 3) for r in (rows, other))
    changed = [x.select("slot", F.col("hash").alias("a")).join(y.select("slot", F.col("hash").alias("b")), "slot").where("a <> b").count() for x, y in zip(mine, theirs)]
    assert changed == [1, 2, 1, 1]
