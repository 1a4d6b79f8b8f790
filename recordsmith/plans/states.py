"""Queries of states, histories and artefacts; their JSON is made from orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import artefacts, migration, states
from ..operators.external import batch_extraction, parsed_answers
from ..operators.visual import result_blocks
from .base import fixture, plain

_STATES = """
SELECT id, CASE id % 7 WHEN 0 THEN concat('{"prog.predict": {"lm": {"model": "m', k, '"}, "traces": [1, ', k, ']}, "x": 1}') WHEN 1 THEN concat('{"prog": {"predict": {"lm": {"model": "m', k, '"}, "train": [', k, ']}, "extra": ', k, ', "more": []}}')
  WHEN 2 THEN concat('{"traces": [1, {"a": ', k, '}], "lm": null, "settings": {}}') WHEN 3 THEN concat('{"lm": {"model": "m', k, '"}, "traces": "none", "settings": {"k": ', k, '}}') WHEN 4 THEN concat('{"prog": {"other": ', k, '}}')
  WHEN 5 THEN concat('{"broken": ', k) ELSE concat('{"prog": {"predict": ', k, '}, "traces": []}') END AS state
FROM (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR(20)) AS k FROM {{orders}}) o
"""


def q70_state_layouts(spark, sf_dir):
    rows = states.normal_states(fixture(spark, sf_dir, _STATES))
    get = lambda path, kind: F.try_variant_get("state", path, kind)
    return rows.select(
        "id", "layout", F.array_join(F.array_sort(F.map_keys(get("$", "map<string,variant>"))), ",").alias("keys"), get("$['prog.predict'].lm.model", "string").alias("model"),
        F.size(get("$['prog.predict'].traces", "array<variant>")).cast("long").alias("traces"), get("$['prog.predict'].signature.fields[1].description", "string").alias("second_field"), get("$._settings.k", "long").alias("setting"),
    )


_ENTRIES = """
SELECT id, CASE id % 5 WHEN 0 THEN concat('{"messages": [{"role": "r', k, '", "lm": {"deep": {"lm": 1}}}], "outputs": ["lm", {"lm": 1, "n": [', k, ', {"lm": 2}, [[{"lm": 3, "z": null}]]]}], "kwargs": {"messages": [1], "temperature": 0.5, "lm": {"x": 1}}, "other": 1}')
  WHEN 1 THEN concat('{"outputs": [', k, '], "model": "m', k, '", "kwargs": {"messages": []}}') WHEN 2 THEN '{"kwargs": {"lm": [1]}, "model": null}' WHEN 3 THEN concat('[', k, ']') ELSE concat('{"model": ', k) END AS entry
FROM (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR(20)) AS k FROM {{orders}}) o
"""


def q71_clean_history(spark, sf_dir):
    return states.clean_history(fixture(spark, sf_dir, _ENTRIES), "id").select("id", F.to_json("entry").alias("entry"))


_TARGETS = """
SELECT id, CASE WHEN id % 31 = 0 THEN concat('{"figure": "', k, '"}') WHEN id % 37 = 0 THEN concat('[', k) ELSE concat('[{"target_id": "t', k, '", "figure": "f", "pages": [1], "caption": null, "num": true, ', CASE WHEN id % 3 = 0 THEN '' ELSE '"rel": "likely", ' END,
  '"panels": [], "page_images": [{"page": 1, "image_path": "p1"}, {"page": ', k, CASE WHEN id % 4 = 0 THEN '}, 5' ELSE ', "image_path": "p2"}' END, ']}, ', CASE id % 5 WHEN 0 THEN k WHEN 1 THEN '{"target_id": "u"}' ELSE
  '{"target_id": "u", "figure": "f", "pages": [], "caption": "c", "num": false, "rel": "x", "panels": [], "page_images": "none"}' END, ']') END AS artefact
FROM (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR(20)) AS k FROM {{orders}}) o
"""


def q72_artefact_errors(spark, sf_dir):
    return artefacts.broken_rules(fixture(spark, sf_dir, _TARGETS), "id", "artefact", "targets")


_ANCHORS = """
SELECT id, concat('{"schema_version": "', CASE WHEN id % 3 = 0 THEN 'v0' ELSE 'aee.md_anchor_index.v1' END, '", "anchors": ', CASE WHEN id % 4 = 0 THEN '{}' ELSE '[1]' END, CASE WHEN id % 5 = 0 THEN '' ELSE ', "index": {}' END,
  ', "duplicates": ', CASE WHEN id % 2 = 0 THEN '[]' ELSE concat('{"a": ', k, '}') END, CASE WHEN id % 7 = 0 THEN ', "invalid_blocks": [1]' ELSE '' END, '}') AS artefact
FROM (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR(20)) AS k FROM {{orders}}) o
"""


def q73_artefact_verdicts(spark, sf_dir):
    rows = fixture(spark, sf_dir, _ANCHORS)
    return artefacts.verdicts(rows, artefacts.broken_rules(rows, "id", "artefact", "anchors"), "id")


_ASKED = """SELECT event_id AS id, concat('{"k": ', CAST(event_id AS VARCHAR(20)), ', "pad": "', repeat('x', CAST(event_id % 40 AS INT)), '"}') AS prompt FROM {{events}}"""


def _cut_short(prompts: list[str], budget: int | None) -> list[tuple[str, str | None]]:
    """A model that repeats the prompt up to its budget; every second answer says why it ends."""
    return [(p[:budget], "MAX_TOKENS" if len(p) > budget and len(p) % 2 == 0 else None) for p in prompts]


def q74_retried_answers(spark, sf_dir):
    rows = parsed_answers(fixture(spark, sf_dir, _ASKED), "prompt", _cut_short, budget=16)
    kinds = F.array_join(F.transform("warnings", lambda w: F.array_join(F.slice(F.split(w, ":"), 1, 2), ":")), ",")
    return rows.select("id", F.get_json_object("parsed", "$.k").cast("long").alias("k"), F.col("attempts").cast("long").alias("attempts"), "status", kinds.alias("trail"), F.length("raw").cast("long").alias("n"))


def q83_batch_extraction(spark, sf_dir):
    """Conversations asked for by number, some of which there are not; a turn is a document, and long ones get no whole answer."""
    documents = fixture(spark, sf_dir, "SELECT conv_id AS id, concat('{\"n\": ', CAST(length(text) AS VARCHAR(20)), ', \"text\": \"', repeat('y', CAST(length(text) % 30 AS INT)), '\"}') AS text FROM {{conversations}} WHERE turn = 0")
    wanted = fixture(spark, sf_dir, "SELECT o_orderkey % 2000 AS id FROM {{orders}}")
    return batch_extraction(wanted, documents, "id", _cut_short, 40).select("id", F.get_json_object("parsed", "$.n").cast("long").alias("n"), "status")


_VERSIONS = """
SELECT id, CASE id % 8 WHEN 0 THEN concat('{"version": "0.8", "model": "m', k, '", "score": ', k, '}') WHEN 1 THEN concat('{"version": "0.9", "lm": {"model": "m', k, '"}, "score": ', k, '}') WHEN 2 THEN concat('{"version": "1.0", "a": ', k, '}')
  WHEN 3 THEN concat('{"dspy": {}, "a": ', k, '}') WHEN 4 THEN concat('{"version": "0.5", "a": ', k, '}') WHEN 5 THEN concat('{"a": ', k, '}') WHEN 6 THEN concat('[', k, ']') ELSE concat('{"version": "0.7", "score": ', k, '}') END AS state
FROM (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR(20)) AS k FROM {{orders}}) o
"""


def _text(value: str):
    return F.lit(value).cast("variant")


def _get(path: str):
    return F.try_variant_get("state", path, "variant")


def _object(key: str, value):
    return F.to_variant_object(F.create_map(F.lit(key), value))


#: Version -> step: a model's name becomes an object; a score becomes a metric, and the version goes; the oldest goes to the one before last.
STEPS = {
    "0.7": lambda rows: rows.withColumn("state", migration.with_keys(F.col("state"), model=_text("none"), version=_text("0.8"))),
    "0.8": lambda rows: rows.withColumn("state", migration.with_keys(F.col("state"), ["model"], lm=_object("model", _get("$.model")), version=_text("0.9"))),
    "0.9": lambda rows: rows.withColumn("state", migration.with_keys(F.col("state"), ["score", "version"], metrics=_object("f1", _get("$.score")))),
}


def q75_migrated_states(spark, sf_dir):
    done = migration.migrated_states(fixture(spark, sf_dir, _VERSIONS), STEPS)
    return done.select("id", F.to_json("state").alias("state"), "from_version", "to_version", F.array_join("trail", ">").alias("trail"), "outcome")


def q76_migration_report(spark, sf_dir):
    rows = fixture(spark, sf_dir, _VERSIONS)
    both = [migration.migration_report(rows, "id", STEPS, dry_run=d).withColumn("dry_run", F.lit(d)) for d in (True, False)]
    return both[0].unionByName(both[1]).groupBy("dry_run", "action", "status", "from_version", "to_version", "steps").agg(F.count(F.lit(1)).alias("n"))


_HEADERS = """
SELECT id, concat('name', CASE WHEN id % 2 = 0 THEN ',size' ELSE '' END, CASE WHEN id % 3 = 0 THEN ',unit' ELSE '' END, CASE WHEN id % 5 = 0 THEN ',value,note' ELSE '' END, CASE WHEN id % 7 = 0 THEN ',key,text' ELSE '' END) AS header
FROM (SELECT p_partkey AS id FROM {{part}}) p
"""
_FORMATS = {"sizes": ["name", "size", "unit"], "values": ["name", "value", "note", "unit"], "texts": ["key", "text"]}


def q77_format_report(spark, sf_dir):
    return migration.format_report(fixture(spark, sf_dir, _HEADERS).withColumn("columns", F.split("header", ",")), "id", _FORMATS)


_BLOCKS = """
SELECT id, concat('Label ', k) AS label, concat('{"target_id": "t', k, '", ', CASE WHEN id % 2 = 0 THEN concat('"figure": "Fig ', k, '", ') ELSE '' END, '"tables": ', CASE id % 6 WHEN 0 THEN '[]' WHEN 1 THEN 'null' WHEN 2 THEN concat('[{"columns": ["a|b", {"name": "x ", "unit": "mM"}], "rows": [[1, true], [', k, '], "s"]}]')
  WHEN 3 THEN '[{"panel": "a", "columns": ["c"], "rows": [[null], [" p  q "]]}, {"columns": ["d"], "rows": 5}, 7]' WHEN 4 THEN '[{"panel": "z", "columns": []}]' ELSE '[{"columns": []}, 1]' END, ', "warnings": ', CASE WHEN id % 5 = 0 THEN '["w|1", 2.5]' ELSE '[]' END, '}') AS result
FROM (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR(20)) AS k FROM {{orders}}) o
"""


def q80_result_blocks(spark, sf_dir):
    return result_blocks(fixture(spark, sf_dir, _BLOCKS)).select("id", "block", F.array_join("warnings", ",").alias("warnings"))


_CROPS = """
SELECT id, concat('{"target_id": "t', k, '"', CASE id % 3 WHEN 0 THEN ', "failed": true' WHEN 1 THEN ', "failed": false' ELSE '' END, CASE WHEN id % 4 = 0 THEN ', "status": "old"' ELSE '' END, CASE WHEN id % 5 = 0 THEN concat(', "crop_width_px": ', k, ', "pages": null') ELSE '' END, '}') AS crop
FROM (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR(20)) AS k FROM {{orders}}) o
"""


def q81_normal_crops(spark, sf_dir):
    return fixture(spark, sf_dir, _CROPS).select("id", F.to_json(artefacts.normal_crop(F.parse_json("crop"))).alias("crop"))


QUERIES = {f.__name__: f for f in (q70_state_layouts, q71_clean_history, q72_artefact_errors, q73_artefact_verdicts, q74_retried_answers, q75_migrated_states, q76_migration_report, q77_format_report, q80_result_blocks, q81_normal_crops, q83_batch_extraction)}
ORACLES = {
    "q70_state_layouts": f"""
WITH s AS (SELECT id, CASE WHEN json_valid(state) THEN state::JSON END AS j FROM ({plain(_STATES)})),
l AS (SELECT *, CASE WHEN j IS NULL THEN 'invalid' WHEN len(list_filter(json_keys(j), lambda k: starts_with(k, 'prog.'))) > 0 THEN 'native' WHEN json_type(j, '$.prog.predict') = 'OBJECT' THEN 'nested'
  WHEN len(list_intersect(json_keys(j), ['lm', 'traces', 'settings'])) > 0 THEN 'flat' ELSE 'unknown' END AS layout FROM s),
p AS (SELECT *, CASE layout WHEN 'native' THEN j -> '$."prog.predict"' WHEN 'nested' THEN j -> '$.prog.predict' WHEN 'flat' THEN j END AS part,
  CASE layout WHEN 'native' THEN json_keys(j) WHEN 'nested' THEN list_transform(list_distinct(list_append(json_keys(j, '$.prog'), 'predict')), lambda k: 'prog.' || k)
    WHEN 'flat' THEN CASE WHEN len(json_keys(j, '$.settings')) > 0 THEN ['prog.predict', '_settings'] ELSE ['prog.predict'] END END AS ks FROM l)
SELECT id, layout, array_to_string(list_sort(ks), ',') AS keys, part ->> '$.lm.model' AS model, CASE WHEN part IS NULL THEN NULL WHEN json_type(part, '$.traces') = 'ARRAY' THEN json_array_length(part, '$.traces') ELSE 0 END::BIGINT AS traces,
  CASE WHEN layout IN ('nested', 'flat') THEN '${{reasoning}}' END AS second_field, CASE WHEN layout = 'flat' THEN (j ->> '$.settings.k')::BIGINT END AS setting FROM p""",
    "q71_clean_history": """
SELECT id, CASE id % 5 WHEN 0 THEN '{"kwargs":{"temperature":0.5},"messages":[{"role":"r' || k || '"}],"model":"","outputs":["lm",{"n":[' || k || ',{},[[{"z":null}]]]}]}' WHEN 1 THEN '{"messages":[],"model":"m' || k || '","outputs":[' || k || ']}'
  WHEN 2 THEN '{"kwargs":{},"messages":[],"model":null,"outputs":[]}' END AS entry FROM (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS k FROM orders)""",
    "q72_artefact_errors": f"""
WITH s AS (SELECT id, CASE WHEN json_valid(artefact) THEN artefact::JSON END AS j FROM ({plain(_TARGETS)})),
e AS (SELECT id, unnest(json_extract(j, '$[*]')) AS e, generate_subscripts(json_extract(j, '$[*]'), 1) AS i FROM s WHERE json_type(j) = 'ARRAY'),
p AS (SELECT id, i, unnest(json_extract(e, '$.page_images[*]')) AS e, generate_subscripts(json_extract(e, '$.page_images[*]'), 1) AS n FROM e WHERE json_type(e, '$.page_images') = 'ARRAY'),
k AS (SELECT id, '$[' || i || ']' AS path, e, ['target_id', 'figure', 'pages', 'caption', 'num', 'rel', 'panels', 'page_images'] AS ks FROM e UNION ALL SELECT id, '$[' || i || '].page_images[' || n || ']', e, ['page', 'image_path'] FROM p),
r AS (SELECT id, path, CASE WHEN json_type(e) <> 'OBJECT' THEN ['not_object'] ELSE list_transform(list_filter(ks, lambda x: NOT list_contains(json_keys(e), x)), lambda x: 'missing_key:' || x) END AS rules FROM k)
SELECT id, path, 'error' AS severity, unnest(rules) AS rule FROM r
UNION ALL SELECT id, '$', 'error', CASE WHEN j IS NULL THEN 'no_json' ELSE 'not_list' END FROM s WHERE j IS NULL OR json_type(j) <> 'ARRAY'""",
    "q73_artefact_verdicts": """
WITH n AS (SELECT o_orderkey AS id, (o_orderkey % 3 = 0)::BIGINT + (o_orderkey % 4 = 0)::BIGINT + (o_orderkey % 5 = 0)::BIGINT AS errors, (o_orderkey % 2 <> 0)::BIGINT + (o_orderkey % 7 = 0)::BIGINT AS warnings FROM orders)
SELECT id, CASE WHEN errors > 0 THEN 'fail' ELSE 'ok' END AS status, errors, warnings FROM n""",
    "q74_retried_answers": f"""
WITH a AS (SELECT id, prompt, length(prompt) AS n, CASE WHEN length(prompt) <= 16 THEN 1 WHEN length(prompt) <= 32 THEN 2 WHEN length(prompt) <= 64 THEN 3 END AS tries FROM ({plain(_ASKED)})),
f AS (SELECT *, CASE WHEN n % 2 = 0 THEN 'model_json_generation_retry' ELSE 'model_json_parse_retry' END AS failed, coalesce(tries, 4) - 1 AS misses FROM a)
SELECT id, CASE WHEN tries IS NOT NULL THEN CAST(prompt::JSON ->> '$.k' AS BIGINT) END AS k, CAST(coalesce(tries, 3) AS BIGINT) AS attempts, CASE WHEN tries IS NULL THEN 'failed' ELSE 'ok' END AS status,
  array_to_string(list_concat(list_transform(range(1, misses + 1), lambda i: failed || ':' || i), CASE WHEN tries > 1 THEN ['model_json_recovered_after_retry:' || tries] ELSE [] END), ',') AS trail, least(n, 64) AS n FROM f""",
    "q75_migrated_states": """
SELECT id, CASE id % 8 WHEN 0 THEN '{"lm":{"model":"m' || k || '"},"metrics":{"f1":' || k || '},"version":"1.0"}' WHEN 1 THEN '{"lm":{"model":"m' || k || '"},"metrics":{"f1":' || k || '},"version":"1.0"}' WHEN 2 THEN '{"a":' || k || ',"version":"1.0"}' WHEN 3 THEN '{"a":' || k || ',"dspy":{}}'
  WHEN 4 THEN '{"a":' || k || ',"version":"0.5"}' WHEN 5 THEN '{"a":' || k || '}' WHEN 7 THEN '{"lm":{"model":"none"},"metrics":{"f1":' || k || '},"version":"1.0"}' END AS state, v AS from_version, CASE WHEN v IN ('0.7', '0.8', '0.9') THEN '1.0' ELSE v END AS to_version,
  CASE v WHEN '0.7' THEN '0.7>0.8>0.9>1.0' WHEN '0.8' THEN '0.8>0.9>1.0' WHEN '0.9' THEN '0.9>1.0' ELSE coalesce(v, '') END AS trail, ['migrated', 'migrated', 'up_to_date', 'up_to_date', 'no_path', 'no_version', 'invalid', 'migrated'][id % 8 + 1] AS outcome
FROM (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS k, ['0.8', '0.9', '1.0', '1.0', '0.5', NULL, NULL, '0.7'][o_orderkey % 8 + 1] AS v FROM orders)""",
    "q76_migration_report": """
WITH o AS (SELECT o_orderkey % 8 AS kind, ['0.8', '0.9', '1.0', '1.0', '0.5', NULL, NULL, '0.7'][o_orderkey % 8 + 1] AS v FROM orders),
r AS (SELECT true AS dry_run, CASE WHEN v = '1.0' THEN 'skip' ELSE 'would_migrate' END AS action, CASE WHEN v = '1.0' THEN 'up_to_date' ELSE 'success' END AS status, v AS from_version, v AS to_version, 0::BIGINT AS steps FROM o
  UNION ALL SELECT false, CASE WHEN v = '1.0' THEN 'skip' ELSE 'migrated' END, CASE WHEN v = '1.0' THEN 'up_to_date' WHEN kind = 6 THEN 'failed' ELSE 'success' END, v, CASE WHEN v IN ('0.7', '0.8', '0.9') THEN '1.0' ELSE v END, CASE v WHEN '0.7' THEN 3 WHEN '0.8' THEN 2 WHEN '0.9' THEN 1 ELSE 0 END FROM o)
SELECT *, count(*) AS n FROM r GROUP BY ALL""",
    "q77_format_report": f"""
WITH h AS (SELECT id, string_split(header, ',') AS c FROM ({plain(_HEADERS)})), f(place, task, names) AS (VALUES {', '.join(f"({i}, '{t}', {names})" for i, (t, names) in enumerate(_FORMATS.items()))}),
m AS (SELECT id, place, task, list_filter(names, lambda x: NOT list_contains(c, x)) AS missing, len(names) AS n FROM h, f),
b AS (SELECT * FROM m WHERE len(missing) < n * 0.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY len(missing) > 0, place) = 1)
SELECT h.id, task, CASE WHEN task IS NULL THEN 'skip' ELSE 'would_migrate' END AS action, CASE WHEN task IS NULL THEN 'unknown_format' ELSE 'success' END AS status, array_to_string(missing, ',') AS missing FROM h LEFT JOIN b ON b.id = h.id""",
    "q80_result_blocks": """
WITH o AS (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS k FROM orders), n AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'Fig ' || k ELSE 'Label ' || k END AS name, chr(10) AS nl FROM o),
b AS (SELECT *, CASE id % 6 WHEN 2 THEN '### Extracted table from ' || name || nl || nl || '| a\\|b | x (mM) |' || nl || '| --- | --- |' || nl || '| 1 | True |' || nl || '| ' || k || ' |  |' || nl || '| s |  |'
  WHEN 3 THEN '### Extracted tables from ' || name || nl || nl || '#### Panel a' || nl || nl || '| c |' || nl || '| --- |' || nl || '|  |' || nl || '| p q |' || nl || nl || '#### Whole figure' || nl || nl || '| d |' || nl || '| --- |'
  WHEN 4 THEN '### Extracted table from ' || name || nl || nl || '#### Panel z' WHEN 5 THEN '### Extracted tables from ' || name || nl || nl || '#### Whole figure' ELSE '' END AS body FROM n)
SELECT id, CASE WHEN body = '' THEN '' WHEN id % 5 = 0 THEN body || nl || nl || nl || '_Extraction warnings:_' || nl || '- w\\|1' || nl || '- 2.5' ELSE body END AS block,
  CASE id % 6 WHEN 2 THEN 't' || k || ':row_2_column_count_mismatch,t' || k || ':row_3_column_count_mismatch' WHEN 3 THEN 't' || k || ':table_rows_not_list,t' || k || ':table_not_object' WHEN 4 THEN 't' || k || ':table_missing_columns'
  WHEN 5 THEN 't' || k || ':table_missing_columns,t' || k || ':table_not_object' ELSE '' END AS warnings FROM b""".replace("\\\\", "\\"),
    "q81_normal_crops": """
SELECT id, '{"crop_area_ratio":0,"crop_height_px":0,"crop_path":"","crop_width_px":' || CASE WHEN id % 5 = 0 THEN k ELSE '0' END || ',"pages":' || CASE WHEN id % 5 = 0 THEN 'null' ELSE '[]' END || ',"parts":[],"schema_version":"aee.figure_crop.v2","status":"'
  || CASE WHEN id % 4 = 0 THEN 'old' WHEN id % 3 = 0 THEN 'fail' ELSE 'ok' END || '","target_id":"t' || k || '","warnings":[]}' AS crop FROM (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS k FROM orders)""",
    "q83_batch_extraction": """
WITH d AS (SELECT conv_id AS id, min('{"n": ' || length(text) || ', "text": "' || repeat('y', length(text) % 30) || '"}') AS text FROM conversations WHERE turn = 0 AND text IS NOT NULL GROUP BY 1), w AS (SELECT DISTINCT o_orderkey % 2000 AS id FROM orders)
SELECT w.id, CASE WHEN length(text) <= 40 THEN CAST(text::JSON ->> '$.n' AS BIGINT) END AS n, CASE WHEN text IS NULL THEN 'missing' WHEN length(text) <= 40 THEN 'ok' ELSE 'failed' END AS status FROM w LEFT JOIN d ON d.id = w.id""",
}
