"""Lookups, declarations, whole writes, build checks, merged statistics, the document metric and result blocks on hard cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from recordsmith.operators import artefacts, corpus, external, reports, scoring, visual
from recordsmith.operators.corpus import Field, Task
from recordsmith.sources import files, sinks


def test_document_and_existence(spark, tmp_path):
    (tmp_path / "Paper1_parsed.md").write_text("one")
    (tmp_path / "b.md").write_text("two")
    assert files.document(spark, str(tmp_path), "PAPER1") == "one"
    with pytest.raises(FileNotFoundError):
        files.document(spark, str(tmp_path), "none")
    stems = spark.createDataFrame([("Paper1_parsed",), ("b",), ("b",)], "stem string")
    keys = spark.createDataFrame([("Paper1",), ("paper1",), ("b",), ("b",), (None,)], "doc_key string")
    assert {(r.doc_key, r.exists) for r in files.existing(stems, keys).collect()} == {("Paper1", True), ("paper1", False), ("b", True), (None, False)}


def test_one_split(spark, tmp_path):
    path = str(tmp_path / "splits.json")
    (tmp_path / "splits.json").write_text('{"train": ["A.pdf", "a", "b"], "val": []}')
    assert sorted(r.doc_key for r in files.split(spark, path, "train").collect()) == ["a", "b"]
    assert files.split(spark, path, "val").count() == 0
    with pytest.warns(UserWarning, match="train, val"):
        assert files.split(spark, path, "test").count() == 0


def test_declarations_come_back(tmp_path):
    task = Task("t", (Field("a", required=True, columns=("A", "b")), Field("n", "int", low=0, high=5.5, default=3), Field("k", choices=("x", "y"), pattern="^x"), Field("ok", "bool")), ("a", "n"))
    files.write_declaration(task, str(tmp_path / "t.json"))
    again = files.task_from(json.loads((tmp_path / "t.json").read_text()))
    assert again.compare == task.compare and [(f.name, f.kind, f.required, f.low, f.high, f.pattern, f.default, tuple(f.choices), tuple(f.columns or (f.name,))) for f in again.fields] == [
        (f.name, f.kind, f.required, f.low, f.high, f.pattern, f.default, tuple(f.choices), tuple(f.columns or (f.name,))) for f in task.fields
    ]


def test_paths_below_a_folder():
    config = {"a": "x/y", "b": {"c": ["./z", 3, "plain"], "d": "https://x/y", "e": "/abs/p"}, "m": "Qwen/q3", "n": "INFO"}
    assert files.resolved_paths(config, "/root") == {"a": "/root/x/y", "b": {"c": ["/root/./z", 3, "plain"], "d": "https://x/y", "e": "/abs/p"}, "m": "Qwen/q3", "n": "INFO"}


def test_histories_and_analyses_are_written_whole(spark, tmp_path):
    path = str(tmp_path / "history")
    entries = spark.createDataFrame([(1, '{"outputs": [{"lm": 1, "a": 2}]}'), (2, "no"), (3, '{"model": "m"}')], "id int, entry string")
    assert sinks.write_history(entries, "id", path) == 2
    assert sorted(r.value for r in sinks.rows_of(spark, path).collect()) == ['{"messages":[],"model":"","outputs":[{"a":2}]}', '{"messages":[],"model":"m","outputs":[]}']
    assert sinks.write_history(entries.where("id = 3"), "id", path) == 1 and [p.name for p in tmp_path.iterdir()] == ["history"]
    with pytest.raises(Exception, match="boom"):  # a writer that fails leaves what was there
        sinks.write_whole(spark.range(3).selectExpr("raise_error('boom') x"), path, "json")
    assert sinks.rows_of(spark, path).count() == 1 and [p.name for p in tmp_path.iterdir()] == ["history"]
    rules = spark.createDataFrame([("r1", "entity", None, 3), ("r2", "field", "ph", 1)], "id string, level string, field_name string, evidence long")
    apart = spark.createDataFrame([("d1", "a", "b")], "id string, text string, other string")
    sinks.write_analysis(rules, apart, str(tmp_path / "analysis"), "t", 7, "2024-01-01T00:00:00")
    info, r, d = sinks.read_analysis(spark, str(tmp_path / "analysis"), "id string, level string, field_name string, evidence long", "id string, text string, other string")
    assert [tuple(x) for x in info.collect()] == [("t", 7, "2024-01-01T00:00:00")] and sorted(map(tuple, r.collect())) == sorted(map(tuple, rules.collect())) and [tuple(x) for x in d.collect()] == [("d1", "a", "b")]
    assert [x.id for x in sinks.rules_of(r, "field").collect()] == [x.id for x in sinks.rules_of(r, field="ph").collect()] == ["r2"]


def test_build_inputs(spark):
    some = spark.createDataFrame([("a",), ("b",)], "k string")
    corpus.check_build(some, some, None, 3)
    with pytest.raises(ValueError, match="gold cannot be empty; limit must be a positive integer or None; seed must be an integer"):
        corpus.check_build(some, some.limit(0), 0, "x")
    assert [r.k for r in corpus.with_gold(some, some.where("k = 'a'").union(some.where("k = 'a'")), "k").collect()] == ["a"]


def test_merged_statistics(spark):
    one = spark.createDataFrame([("a", 1), ("b", None)], "name string, value int")
    assert {tuple(r) for r in reports.merged_statistics(one, spark.createDataFrame([("b", 2), ("c", 3)], one.schema)).collect()} == {("a", 1), ("b", 2), ("c", 3)}


def test_retryable_errors(spark):
    rows = spark.createDataFrame([("Server DISCONNECTED",), ("HTTP 503",), ("Timeout!",), ("bad request 400",), (None,)], "e string")
    assert [r.r for r in rows.select(external.retryable(F.col("e")).alias("r")).collect()] == [True, True, True, False, False]


def test_document_metric(spark):
    gold = '{"experiments": [{"f": "x", "n": 1.0}, {"f": "y", "n": null}]}'
    found = ['{"experiments": [{"f": "y"}, {"f": "x", "n": "1"}]}', '{"experiments": [{"f": "x", "n": 2}, 3, {"f": "z", "n": 1}]}', "no", None, '{"experiments": {}}', '{"experiments": []}', "[1]"]
    rows = spark.createDataFrame([(i, t, gold, "kept") for i, t in enumerate(found)] + [(9, "{", "{", "kept")], "id int, a string, b string, pos string")
    got = {r.id: round(r.f1, 6) for r in scoring.document_metric(rows, "id", "a", "b", {"f": False, "n": True}).collect()}
    assert got == {0: 1.0, 1: round(2 * 1 / 7, 6), 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0, 9: 0.0}


def test_result_blocks(spark):
    cases = ['{"tables": []}', '{"tables": [1]}', '{"target_id": "t", "tables": [{"panel": "b", "columns": ["c"], "rows": [[{"a": 1}], [false], 2, []]}]}', "no", None, '{"tables": [{"columns": ["x"]}], "figure": "", "warnings": "w"}']
    got = {r.id: r for r in visual.result_blocks(spark.createDataFrame(list(enumerate(cases)), "id int, result string").withColumn("label", F.lit("L"))).collect()}
    assert [got[i].block for i in (0, 1, 3, 4)] == [""] * 4 and got[1].warnings == ["result:table_not_object"]
    assert got[2].block == '### Extracted table from L\n\n#### Panel b\n\n| c |\n| --- |\n| {"a":1} |\n| False |\n| 2 |\n|  |' and got[2].warnings == ["t:row_4_column_count_mismatch"]
    assert got[5].block == "### Extracted table from L\n\n| x |\n| --- |"


def test_normal_results(spark):
    row = spark.range(1).select(
        F.to_json(artefacts.normal_boxes(F.parse_json(F.lit('{"target": {"target_id": "t", "x": 1}, "parts": [1], "y": 2}')))).alias("boxes"),
        F.to_json(artefacts.normal_pages(F.parse_json(F.lit('{"dpi": 150.7}')))).alias("pages"), F.to_json(artefacts.normal_crop(F.parse_json(F.lit('{"failed": 1, "own": null}')))).alias("crop"),
    ).first()
    assert row.boxes == '{"parts":[1],"target_id":"t"}' and row.pages == '{"dpi":150,"pages":[]}'
    assert json.loads(row.crop) == {"schema_version": "aee.figure_crop.v2", "target_id": "", "crop_path": "", "pages": [], "parts": [], "crop_width_px": 0, "crop_height_px": 0, "crop_area_ratio": 0, "warnings": [], "status": "fail", "own": None}
