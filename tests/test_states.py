"""States, histories, artefacts, migrations and answers asked for again, on hard cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from recordsmith.operators import artefacts, external, lineage, migration, states


def table(spark, texts, name="state"):
    return spark.createDataFrame(list(enumerate(texts)), f"id int, {name} string")


def dropped(value, key="lm"):
    if isinstance(value, dict):
        return {k: dropped(v, key) for k, v in value.items() if k != key}
    return [dropped(v, key) for v in value] if isinstance(value, list) else value


def test_keys_go_at_any_depth(spark):
    deep = {"lm": 1}
    for i in range(12):
        deep = {"a": [deep, {"lm": i}, []], "b": {"lm": {}}, "lm": [i]}
    values = [deep, {"lm": {}}, [[{"lm": 1}]], {"a": "lm", "b": {"lm.x": 1}}, [], {}, "lm", 3, {"a/b": {"lm": [{}]}, "": [None, {"lm": None}]}]
    rows = table(spark, [*map(json.dumps, values), None], "entry").withColumn("entry", F.parse_json("entry")).withColumn("key", F.lit("mine"))
    got = {r.id: r for r in states.without_key(rows, "id", "entry").select("id", F.to_json("entry").alias("entry"), "key").collect()}
    assert [json.loads(got[i].entry) for i in range(len(values))] == [dropped(v) for v in values]
    assert got[len(values)].entry is None and {r.key for r in got.values()} == {"mine"}
    assert states.without_key(rows.limit(0), "id", "entry").count() == 0


def test_state_layouts(spark):
    texts = ['{"prog.x": 1, "lm": 2}', '{"prog": {"predict": {}, "a": 1, "b": null}}', '{"prog": {"a": 1}, "settings": [0]}', '{"settings": {}, "lm": {"model": "m"}, "traces": [1]}', '{"prog": {"predict": [1]}}', "{}", "[1]", "no", None, '{"prog": {"predict": {"signature": {"s": 1}, "lm": {"k": 1}}}}']
    got = {r.id: (r.layout, None if r.state is None else json.loads(r.state)) for r in states.normal_states(table(spark, texts)).select("id", "layout", F.to_json("state").alias("state")).collect()}
    assert [got[i][0] for i in range(len(texts))] == ["native", "nested", "flat", "flat", "unknown", "unknown", "unknown", "invalid", "invalid", "nested"]
    assert got[0][1] == {"prog.x": 1, "lm": 2} and set(got[1][1]) == {"prog.predict", "prog.a", "prog.b"} and got[1][1]["prog.predict"]["lm"] is None
    assert got[2][1]["_settings"] == [0] and "_settings" not in got[3][1] and got[3][1]["prog.predict"]["traces"] == [1] and got[3][1]["prog.predict"]["lm"] == {"model": "m"}
    assert got[9][1]["prog.predict"] == {"signature": {"s": 1}, "lm": {"k": 1}, "traces": [], "train": [], "demos": []} and got[4][1] is None
    assert len(got[1][1]["prog.predict"]["signature"]["fields"]) == 3


KEYS = {"target_id": "t", "figure": "f", "pages": [], "caption": "", "num": True, "rel": "x", "panels": [], "page_images": []}
CASES = [
    ("manifest", [{"figure": 1, "pages": 1, "caption": 1, "num": 1, "rel": 1, "routing_decision": "skip", "panels": None}, 3, {"routing_decision": "x"}], 8), ("manifest", {}, 1),
    ("targets", [KEYS | {"page_images": [{"page": 1, "image_path": "a"}, {}, 1]}], 3), ("pages", {"pages": [{"page": 1, "image_path": "here", "width_px": 1, "height_px": 1}, {"image_path": "gone"}]}, 4), ("pages", {"pages": 1}, 1),
    ("boxes", [{"target_id": "", "parts": []}, {"target_id": "a", "parts": {}}, {"target_id": "b", "parts": [{"bbox": {"norm": [0, 0, 1, 1]}, "bbox_with_margin": {"norm": [0, 0, 2, 1]}}]}], 4),
    ("crops", [{"status": "fail", "crop_path": "here"}, {"status": "ok"}], 2), ("tables", [{"schema_version": 1, "target_id": "a", "figure": "f", "status": "ok", "tables": {}, "warnings": []}], 1),
    ("anchors", {"schema_version": "aee.md_anchor_index.v1", "anchors": [], "index": {}, "duplicates": {"a": 1}, "invalid_blocks": []}, 1), ("report", {"rows": [], "summary": []}, 1),
    ("insertion", {"schema_version": "aee.visual_table_insertion.v1", "output_markdown": "", "anchors_found": []}, 1),
]


@pytest.mark.parametrize(("stage", "value", "broken"), CASES)
def test_artefact_rules(spark, stage, value, broken):
    rows = table(spark, [json.dumps(value), "no {", None], "artefact").withColumn("path", F.lit("clash"))
    files = spark.createDataFrame([("here",), ("here",)], "path string")
    got = [tuple(r) for r in artefacts.broken_rules(rows, "id", "artefact", stage, files=files).collect()]
    assert len([g for g in got if g[0] == 0]) == broken, got
    assert sorted(g for g in got if g[0]) == [(1, "$", "error", "no_json"), (2, "$", "error", "no_json")]
    verdict = {r.id: r for r in artefacts.verdicts(rows, artefacts.broken_rules(rows, "id", "artefact", stage, files=files), "id").collect()}
    assert verdict[0].errors + verdict[0].warnings == broken and verdict[1].status == "fail" and (verdict[0].status == "ok") == (stage == "anchors")
    assert artefacts.broken_rules(rows.limit(0), "id", "artefact", stage).count() == 0


def test_only_open_rows_are_asked_again(spark):
    asked = spark.sparkContext.accumulator(0)

    def generator(prompts, budget):
        asked.add(len(prompts))
        return [("{}" if budget >= int(p or 0) else "{", None if int(p or 0) % 2 else ("LENGTH" if budget < int(p or 0) else None)) for p in prompts]

    rows = spark.createDataFrame([(i, p, "kept") for i, p in enumerate(["1", "11", "12", "39", "41", "44", None])], "id int, prompt string, raw_ string")
    got = {r.id: r for r in external.parsed_answers(rows, "prompt", generator, 10).collect()}
    assert [got[i].attempts for i in range(7)] == [1, 2, 2, 3, 3, 3, 1] and asked.value == 7 + 5 + 3
    assert [got[i].status for i in range(7)] == ["ok"] * 4 + ["failed"] * 2 + ["ok"]
    assert got[2].warnings == ["model_json_generation_retry:1:finish_reason=LENGTH", "model_json_recovered_after_retry:2"] and got[3].warnings[1].startswith("model_json_parse_retry:2:") and len(got[5].warnings) == 3
    assert got[4].raw == "{" and got[4].parsed is None and got[0].raw_ == "kept"
    assert external.parsed_answers(rows.limit(0), "prompt", generator, 10).count() == 0


def test_migration_chain(spark):
    texts = ['{"version": "a"}', '{"version": "b", "x": 1}', '{"version": "1.0"}', '{"dspy": null}', '{"x": 1}', "[", None, '{"version": 7}']
    put = lambda v: lambda rows: rows.withColumn("state", migration.with_keys(F.col("state"), version=None if v is None else F.lit(v).cast("variant")))
    steps = {"a": put("b"), "b": lambda rows: rows.withColumn("state", migration.with_keys(F.col("state"), ["version"]))}
    got = {r.id: (r.outcome, r.trail, r.state) for r in migration.migrated_states(table(spark, texts), steps).withColumn("state", F.to_json("state")).collect()}
    assert [got[i][0] for i in range(8)] == ["migrated", "migrated", "up_to_date", "up_to_date", "no_version", "invalid", "invalid", "no_path"]
    assert got[0][1] == ["a", "b", "1.0"] and json.loads(got[1][2]) == {"x": 1, "version": "1.0"}
    with pytest.raises(ValueError, match="circle"):
        migration.migrated_states(table(spark, texts), {"a": put("b"), "b": put("a")})
    assert migration.migrated_states(table(spark, texts).limit(0), steps).count() == 0 and migration.migrated_states(table(spark, texts), {}).count() == 8


def test_checkpoints_need_a_shared_folder():
    class Conf:
        get = staticmethod(lambda _: None)

    class Context:
        master = "spark://host"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("D", (), {"isEmpty": lambda self: True})()})()})()
        getConf = staticmethod(lambda: Conf)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.shared_checkpoints(type("Session", (), {"sparkContext": Context()})())


def test_migration_parses_once_and_keeps_partitions(spark, monkeypatch):
    """States are kept before the first step, and rounds do not multiply partitions."""
    kept = []
    monkeypatch.setattr(migration, "settled", lambda df: kept.append(lineage.settled(df)) or kept[-1])
    texts = spark.range(40, numPartitions=2).selectExpr("id", "concat('{\"version\": \"', id % 3, '\"}') state")
    steps = {str(v): (lambda w: lambda rows: rows.withColumn("state", migration.with_keys(F.col("state"), version=F.lit(w).cast("variant"))))(str(v + 1) if v < 2 else "1.0") for v in (0, 1, 2)}
    got = migration.migrated_states(texts, steps)
    assert got.where("outcome = 'migrated' and to_version = '1.0'").count() == 40
    assert kept[0].count() == 40 and all(df.rdd.getNumPartitions() <= max(2, spark.sparkContext.defaultParallelism) for df in kept)
