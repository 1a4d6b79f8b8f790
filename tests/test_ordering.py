"""Ranks, chunks and medians of groups that no task may hold whole."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordsmith.operators import catalog, ordering, rules


def test_ranks_over_partitions(spark):
    """Two groups of very different size, one of them null; names that clash; rows of all partitions."""
    rows = spark.range(20_000).selectExpr("case when id % 50 = 0 then null when id % 50 < 40 then 'hot' else concat('k', id % 7) end g", "(id * 7919) % 20011 x", "id _part", "map(id, id) m").repartition(7)
    got = ordering.ranked(rows, ["g"], [F.desc("x")], "r")
    assert got.columns == ["g", "x", "_part", "m", "r"]
    frame = got.select("g", "x", "r", "_part").toPandas().sort_values("x", ascending=False)
    frame["want"] = frame.fillna("none").groupby("g").cumcount() + 1
    assert len(frame) == 20_000 and (frame["r"] == frame["want"]).all()
    assert got.where("m[_part] <> _part").count() == 0
    assert ordering.ranked(rows.limit(0), ["g"], [F.col("x")]).count() == 0 and ordering.ranked(rows, [], [F.col("x")]).agg(F.max("rank")).first()[0] == 20_000


def test_chunks_of_one_key(spark):
    rows = spark.range(5_003).selectExpr("'all' k", "id x", "cast(id as string) v").repartition(5)
    got = sorted(ordering.chunked(rows, ["k"], [F.col("x")], F.col("v"), 100).collect(), key=lambda r: r.chunk)
    assert [r.chunk for r in got] == list(range(51)) and {(r.chunks, r.total) for r in got} == {(51, 5_003)}
    assert [v for r in got for v in r["values"]] == [str(i) for i in range(5_003)] and got[-1].n == 3 and got[7].first == 701
    assert ordering.chunked(rows.limit(0), ["k"], [F.col("x")], F.col("v")).count() == 0


@pytest.mark.parametrize("small", [10, 10_000])
def test_selection_is_exact(spark, monkeypatch, small):
    monkeypatch.setattr(ordering, "SMALL", small)
    rng = np.random.default_rng(2)
    columns = {"normal": rng.normal(size=6_000), "wide": np.exp(rng.normal(size=3_001) * 30), "ties": rng.integers(0, 3, 5_000).astype(float), "one": np.ones(4_000), "few": np.array([3.0, 1.0])}
    rows = spark.createDataFrame([(c, float(v)) for c, vs in columns.items() for v in vs], '"column" string, value double'.replace('"', "`"))
    wanted = [(c, k) for c, vs in columns.items() for k in {0, len(vs) // 3, (len(vs) - 1) // 2, len(vs) // 2, len(vs) - 1}]
    got = ordering.selected(rows, wanted)
    assert got == {(c, k): float(np.sort(columns[c])[k]) for c, k in wanted}
    assert ordering.selected(rows, []) == {}


def test_rules_and_versions_of_one_large_scope(spark):
    rows = spark.range(3_000).selectExpr("'t' task", "cast(id % 11 as string) created", "lpad(id, 5, '0') name", "id pos", "case when id % 4 > 0 then id % 97 / 97.0D end f1")
    versions = sorted(catalog.versioned(rows).collect(), key=lambda r: r.version)
    assert [r.version for r in versions] == list(range(1, 3_001)) and [(r.created, r.name) for r in versions] == sorted((r.created, r.name) for r in versions)
    places = [r.pos for r in sorted(catalog.compared(rows).collect(), key=lambda r: r.place)]
    assert places == list(range(3_000))  # the first run has no metric
    places = [r.pos for r in sorted(catalog.compared(rows.where("pos > 0")).collect(), key=lambda r: r.place)]
    assert places == sorted(range(1, 3_000), key=lambda i: (-(i % 97 / 97.0 if i % 4 else 0.0), i))
    seen = spark.range(2_000).selectExpr("'s' scope", "id % 40 doc", "id pos", "case when id = 1500 then 'B b' when id % 2 = 0 then 'A' else ' a' end text")
    got = rules.consensus(seen, "scope").first()
    assert (got.evidence, got.kind, got.text, got.other_text, got.examples, got.documents) == (2_000, "discrepancy", "A", "B b", "A /  a / A", "0,1,2,3,4")
