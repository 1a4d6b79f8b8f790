"""Tasks as SQL functions, the cache's commits, the extraction source and rings of several batches."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from recordsmith.operators import corpus
from recordsmith.operators.corpus import Field, Task
from recordsmith.operators.tasks import Registry
from recordsmith.sources import extraction_source
from recordsmith.sources.cache import Cache
from recordsmith.streaming import history

TASK = Task("exp eriment", (
    Field("formula", required=True, columns=("Formula ", "name`s")), Field("ph", "float", low=0, high=14, columns=("PH", "acid")), Field("n", "int", default=3), Field("kind", choices=("a'b", "c\\d")),
    Field("code", pattern=r"^\w+'\d$"), Field("ok", "bool"), Field("gone", columns=("not there",)),
))


def test_sql_functions_equal_the_conversion(spark):
    rows = spark.createDataFrame([
        ("H2O", None, "7", None, "a'b", "x'1", "TRUE"), ("", "n", "15", "x", None, None, "no"), (None, "", "x", "4.0", "c\\d", "y", None), ("A", "B", "", "-2", "zz", "x'1", "1"), ("A", None, "1e1", " 5 ", None, "", ""),
    ], "FORMULA string, `name``s` string, acid string, n string, kind string, code string, ok string")
    registry = Registry(spark)
    registry.register(TASK)
    got = registry.converted(rows, TASK.name, ["acid"])
    want = corpus.converted(rows.withColumnRenamed("name`s", "other"), Task(TASK.name, (Field("formula", required=True, columns=("formula", "other")), *TASK.fields[1:])), ["acid"])
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert spark.sql("SELECT `convert_exp eriment_ph`('', '3.50')").first()[0] == 3.5 and registry.names() == [TASK.name]
    with pytest.raises(ValueError, match="registered already"):
        registry.register(Task("fine", (Field("a"),)), TASK)
    with pytest.raises(ValueError, match="declared twice"):
        registry.register(Task("fine", (Field("a"),)), Task("bad", (Field("a"), Field("a"))))
    assert registry.names() == [TASK.name]  # all or none
    registry.unregister(TASK.name)
    with pytest.raises(Exception, match="convert_exp"):
        spark.sql("SELECT `convert_exp eriment_ph`('', '3.50')").collect()
    with pytest.raises(KeyError):
        registry.unregister("none")


def test_cache_survives_a_writer_that_dies(spark, tmp_path):
    cache = Cache(spark, str(tmp_path / "cache"), "id", "v1")
    worked = spark.sparkContext.accumulator(0)

    def work(rows):
        def run(batches):
            for b in batches:
                worked.add(b.num_rows)
                yield b

        return rows.mapInArrow(run, rows.schema)

    rows = spark.range(20).select("id", F.concat(F.lit("v"), "id").alias("value"), F.when(F.col("id") > 5, F.col("id") * 1.5).alias("x"))
    assert cache.rows() is None and cache.through(rows.where("id < 10"), work).count() == 10 and worked.value == 10
    cache.stage(rows)  # the writer ends before its commit
    (tmp_path / "cache" / "manifests" / "000000000009.json").write_text('{"version": "v1", "da')  # or midway in one
    (tmp_path / "cache" / "manifests" / "000000000008.json").write_text(json.dumps({"version": "v1", "data": "data-gone", "schema": "id long"}))
    assert cache.rows().count() == 10
    assert sorted(r.id for r in cache.through(rows.where("id % 2 = 0"), work).collect()) == list(range(0, 20, 2)) and worked.value == 15
    assert Cache(spark, str(tmp_path / "cache"), "id", "v2").rows() is None
    said = cache.manifest()
    data = spark.read.parquet(f"{tmp_path}/cache/{said['data']}")
    spoilt = data.withColumn("value", F.when(F.col("id") == 4, "changed").otherwise(F.col("value")))
    spoilt.write.parquet(f"{tmp_path}/cache/data-spoilt")
    (tmp_path / "cache" / "manifests" / "000000000099.json").write_text(json.dumps(said | {"data": "data-spoilt"}))
    assert cache.rows().count() == 14
    assert {r.id: r.value for r in cache.through(rows.where("id < 10"), work).collect()} == {i: f"v{i}" for i in range(10)} and worked.value == 16
    for _ in range(4):
        cache.put(rows)
    assert len(list((tmp_path / "cache" / "manifests").glob("*.json"))) == 2 and cache.rows().count() == 20


def test_extraction_source(spark, tmp_path):
    extraction_source.register(spark)
    files = {
        "A_result.json": {"extraction": {"experiments": [{"f": "x", "n": "3", "b": True, "r": 1}, {"f": {"a": 1}, "n": 2.5, "b": None}]}}, "b.json": [{"f": None, "n": 1e400, "b": "yes"}, 3], "c.json": {"extracted_data": None}, "d.json": {"experiments": []},
    }
    (tmp_path / "deep").mkdir()
    for i, (name, value) in enumerate(files.items()):
        ((tmp_path / "deep") if i % 2 else tmp_path).joinpath(name).write_text(json.dumps(value))
    (tmp_path / "e.json").write_bytes(b"\xff{")
    (tmp_path / "_f.json").write_text("[]")
    rows = spark.read.format("extractions").option("fields", '{"f": "str!", "n": "int", "b": "bool"}').option("partitions", "3").load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 3
    got = {(r.doc_key, r.pos): (r.f, r.n, r.b, r._problem) for r in rows.collect()}
    assert got == {
        ("A_result", 0): ("x", 3, True, None), ("A_result", 1): ('{"a": 1}', None, None, "n: no int"), ("b", 0): (None, None, None, "f: missing"), ("b", 1): (None, None, None, "record: not an object"),
        ("c", None): (None, None, None, "file: ValueError"), ("e", None): (None, None, None, "file: UnicodeDecodeError"),
    }
    assert {r._corrupt for r in rows.where("doc_key = 'b' and pos = 1").collect()} == {"3"}


def test_rings_of_several_batches(spark, tmp_path):
    """Late and repeated calls; a key whose last call is long past is closed."""
    batches = [[("a", 3, 100), ("a", 1, 90), ("b", 1, 100)], [("a", 2, 120), ("a", 3, 120), (None, 9, 100), ("a", 4, 130)], [("c", 1, 900_000)], [("c", 2, 900_001)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "key string, seq long, at long").selectExpr("key", "seq", "timestamp_seconds(at) at").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    before = spark.conf.get(history.STORE)
    history.store_for(spark)
    try:
        for i in range(len(batches)):
            stream = spark.readStream.schema("key string, seq long, at timestamp").parquet(f"{tmp_path}/in/*" if i == len(batches) - 1 else f"{tmp_path}/in/[0-{i}]")
            history.streamed_ring(stream, 3, idle_ms=1000, late="1 hour").writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda b, n, i=i: b.write.parquet(f"{tmp_path}/out/{i}-{n}")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(history.STORE, before)
    out = spark.read.parquet(f"{tmp_path}/out/*")
    assert sorted((r.key, r.seq, r.age) for r in history.current_rings(out).collect()) == [("c", 1, 2), ("c", 2, 1)]
    closed = sorted((r.key, r.seq) for r in out.where("closed").collect())
    assert closed == [("a", 2), ("a", 3), ("a", 4), ("b", 1)]


def test_ring_calls_of_the_store():
    """A key costs one reading and one writing of its state in a batch, and a timer in its first only; the timer moves on when it expires."""
    import pandas as pd

    class Store:
        def __init__(self):
            self.calls, self.value, self.timers, self.watermark = [], None, [], 0

        def __getattr__(self, name):
            def called(*args):
                self.calls.append(name)
                if name in ("update", "clear"):
                    self.value = args[0] if args else None
                elif name == "registerTimer":
                    self.timers.append(args[0])
                return {"get": self.value, "getValueState": self, "getListState": self, "getCurrentWatermarkInMs": self.watermark}.get(name)

            return called

    store, ring = Store(), history.Ring(2, 1000)
    ring.init(store)
    store.calls.clear()
    for ms, seqs in ((100, [1, 2]), (900, [3])):
        out = pd.concat(ring.handleInputRows(("a",), iter([pd.DataFrame({"seq": seqs, "ms": [ms] * len(seqs)})]), store))
    assert store.calls == ["get", "update", "registerTimer", "get", "update"] and out.values.tolist() == [["a", 3, 1, 2, False], ["a", 2, 2, 2, False]]
    store.watermark = 1200
    assert not list(ring.handleExpiredTimer(("a",), store, None)) and store.timers == [1100, 1900]
    store.watermark = 1900
    assert pd.concat(ring.handleExpiredTimer(("a",), store, None)).values.tolist() == [["a", 3, 1, 3, True], ["a", 2, 2, 3, True]] and store.value is None


def test_types_of_records(spark):
    from recordsmith.operators import tasks

    made = tasks.record_type(TASK)
    assert [f.name for f in made] == [f.name for f in TASK.fields] and not made["formula"].nullable and made["ph"].metadata == {"low": 0, "high": 14} and made["kind"].metadata == {"choices": ["a'b", "c\\d"]}
    rows = spark.createDataFrame([(1, '{"experiments": [{"formula": "x", "ph": 7, "n": 2, "ok": true}, {"ph": "high"}]}'), (2, "no"), (3, "{}"), (4, None)], "id int, text string")
    got = {r.id: r.experiments for r in tasks.parsed_output(rows, "text", TASK).collect()}
    assert (got[1][0].formula, got[1][0].ph, got[1][0].n, got[1][0].ok) == ("x", 7.0, 2, True) and len(got[1]) == 2 and got[1][1].ph is None and got[2] is None and got[3] is None and got[4] is None


def test_review_goes_on_where_it_was(spark, tmp_path):
    from recordsmith.operators import rules

    apart = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "id string")
    review = rules.Review(Cache(spark, str(tmp_path / "review"), "id", "1"))
    assert review.decisions().count() == 0 and review.open(apart).count() == 3
    review.decide("d1", "a")
    review.decide("d2", "custom", "so")
    review.decide("d1", "b")
    with pytest.raises(ValueError, match="no such action"):
        review.decide("d3", "maybe")
    (tmp_path / "review" / "manifests" / "000000000077.json").write_text("{")
    again = rules.Review(Cache(spark, str(tmp_path / "review"), "id", "1"))
    assert {tuple(r) for r in again.decisions().collect()} == {("d1", "b", None), ("d2", "custom", "so")} and [r.id for r in again.open(apart).collect()] == ["d3"]


def test_batches_ask_once_for_what_is_there(spark):
    from recordsmith.operators import external

    asked = spark.sparkContext.accumulator(0)

    def generator(prompts, budget):
        asked.add(len(prompts))
        return [(p, None) for p in prompts]

    wanted = spark.createDataFrame([("a",), ("a",), ("b",), ("gone",), (None,)], "k string")
    documents = spark.createDataFrame([("a", "{}", 1), ("a", "[1]", 1), ("b", "no", 1), ("c", "{}", 1)], "k string, text string, parsed int")
    done = external.batch_extraction(wanted, documents, "k", generator)
    got = {r.k: (r.status, r.parsed) for r in done.collect()}
    assert got == {"a": ("ok", "[1]"), "b": ("failed", None), "gone": ("missing", None), None: ("missing", None)}
    assert tuple(external.batch_counters(done).first()) == (4, 1, 3) and asked.value == 2
