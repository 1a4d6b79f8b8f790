"""Queries of rules, run catalogues, call protection and JSON texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.json_text import first_object, tolerant_json
from ..operators import catalog, rules
from ..sources import extraction_source
from ..sources.cache import Cache
from ..streaming import history, protection
from .base import fixture, plain, rounded, shared_folder, table

_SEEN = """
SELECT p_brand AS scope, p_type AS field, p_partkey AS pos, p_partkey % 50 AS doc, CASE WHEN p_size % 10 = 0 THEN concat('Keep  ', p_type) WHEN p_size % 10 = 1 AND p_brand > 'Brand#3' THEN 'Drop it' ELSE concat('keep ', lower(p_type)) END AS text
FROM {{part}}
"""


def _groups(spark, sf_dir):
    return rules.consensus(fixture(spark, sf_dir, _SEEN), "scope", "field")


def q40_rule_groups(spark, sf_dir):
    return _groups(spark, sf_dir)


def q41_rule_ids(spark, sf_dir):
    return rules.numbered(_groups(spark, sf_dir), "scope").select("scope", "field", "kind", "id")


_OPEN = """
SELECT event_id AS id, concat('A ', event_type) AS text, concat('B ', event_type) AS other_text, event_id % 9 + 1 AS evidence, CAST(event_id % 11 AS DOUBLE) / 10 AS ratio,
  CASE event_id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'custom' WHEN 3 THEN 'majority' ELSE 'skip' END AS action, CASE WHEN event_id % 2 = 0 THEN concat('own ', event_type) ELSE ' ' END AS custom
FROM {{events}}
"""


def q42_review_policy(spark, sf_dir):
    return rules.reviewed(fixture(spark, sf_dir, _OPEN))


def q43_rule_merge(spark, sf_dir):
    kept = table(spark, sf_dir, "part").select(F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("rule_text"), F.col("p_partkey").alias("pos"))
    new = table(spark, sf_dir, "events").select(F.concat(F.lit("r"), (F.col("event_id") % 5000).cast("string")).alias("id"), F.col("event_type").alias("rule_text"), (F.col("event_id") + 100_000).alias("pos"))
    return rules.merged_rules(kept, new)


_RUNS = """
SELECT concat(event_type, '_', CAST(event_id AS VARCHAR(20)), '.json') AS name, event_type AS task, CAST(floor(event_id / 3) AS BIGINT) AS created, event_id AS pos,
  CASE WHEN event_id % 4 <> 0 THEN round(value, 1) END AS f1 FROM {{events}}
"""


def q44_latest_run(spark, sf_dir):
    return catalog.latest(fixture(spark, sf_dir, _RUNS)).select("task", "name", "created")


def q45_best_run(spark, sf_dir):
    return catalog.best(fixture(spark, sf_dir, _RUNS)).select("task", "name", "f1")


def q46_compared_runs(spark, sf_dir):
    return catalog.compared(fixture(spark, sf_dir, _RUNS)).select("task", "name", F.col("place").cast("long").alias("place"))


def q46b_versions(spark, sf_dir):
    return catalog.versioned(fixture(spark, sf_dir, _RUNS)).select("task", "name", F.col("version").cast("long").alias("version"))


def _calls(spark, sf_dir):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), seconds.alias("at"), (F.col("event_type") != "error").alias("ok"), F.abs("value").alias("duration"))


def q47_circuit_breaker(spark, sf_dir):
    out = protection.replayed(_calls(spark, sf_dir), protection.Breaker(1, 86_400.0, 1))
    return out.groupBy("met", "admitted").agg(F.count(F.lit(1)).alias("n"))


_TIMED = "SELECT user_id AS key, event_id AS seq, CAST(event_id % 977 AS DOUBLE) AS at, CAST(event_id % 7 AS DOUBLE) AS duration FROM {{events}}"


def q48_rate_limit(spark, sf_dir):
    return rounded(protection.rate_limited(fixture(spark, sf_dir, _TIMED), 10.0).select("key", "seq", "start"), "start")


def q49_ring_history(spark, sf_dir):
    return protection.last_calls(_calls(spark, sf_dir), 20).select("key", "seq", F.col("age").cast("long").alias("age"))


_SAID = """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN concat('Result: ', props, ' done') WHEN 1 THEN concat('```json ', props, ' ```') WHEN 2 THEN props WHEN 4 THEN concat('open ', chr(123), ' and "', chr(123), '" then ', props)
  WHEN 5 THEN concat('[', props, ' ', props, ']') WHEN 6 THEN concat(chr(123), '"in": "', chr(125), chr(123), '", "of": ', props, chr(125), ' tail ', chr(125)) ELSE event_type END AS said FROM {{events}}
"""


def q50_first_object(spark, sf_dir):
    return fixture(spark, sf_dir, _SAID).select("event_id", first_object(F.col("said")).alias("found"))


def q51_tolerant_json(spark, sf_dir):
    read = tolerant_json(F.col("said"))
    got = F.coalesce(F.get_json_object(read, "$.k"), F.get_json_object(read, "$[1].k"))
    return fixture(spark, sf_dir, _SAID).select("event_id", got.cast("long").alias("k"))


def q53_stream_tumbling(spark, sf_dir):
    """The events as a stream of files, one batch, all windows, through files in the shared folder."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    whole = spark.read.parquet(path).inputFiles()[0].rstrip("/")
    source = path if not whole.endswith("/events.parquet") else sf_dir
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if source == path else "events.parquet").parquet(source)
    folder = shared_folder(spark, "windows")

    def written(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/rows")

    protection.tumbling(stream, "6 hours").writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").foreachBatch(written).trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.parquet(f"{folder}/rows"), "total")


def q49b_streamed_ring(spark, sf_dir):
    """The events as a stream of three batches, in the order of their ids; the rings after the last one."""
    folder, before = shared_folder(spark, "rings"), spark.conf.get(history.STORE)
    calls = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").alias("at"))
    calls.repartitionByRange(3, "seq").write.parquet(f"{folder}/calls")

    def written(batch, number):
        batch.write.parquet(f"{folder}/rows/batch={number}")

    history.store_for(spark)
    try:
        stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/calls")
        rings = history.streamed_ring(stream, 20, idle_ms=10**13, late="36500 days")
        rings.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(written).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(history.STORE, before)
    return history.current_rings(spark.read.parquet(f"{folder}/rows")).select(F.col("key").cast("long").alias("key"), "seq", "age")


_LOOKED_UP = "SELECT o_orderkey AS id, o_custkey % 10 AS part, o_totalprice AS price FROM {{orders}}"


def q78_cached_rows(spark, sf_dir):
    """Half of the orders are worked on, then all: those that the cache has keep their first round."""
    cache, rows = Cache(spark, shared_folder(spark, "cache"), "id", "v1"), fixture(spark, sf_dir, _LOOKED_UP)
    work = lambda number: lambda df: df.select("id", F.lit(number).cast("long").alias("round"), F.round(F.col("price") * 2, 2).alias("twice"))
    cache.through(rows.where("part < 5"), work(1))
    return rounded(cache.through(rows, work(2)), "twice")


_WRITTEN = """
SELECT id, CASE id % 5 WHEN 0 THEN concat('{"extraction": {"experiments": [{"formula": "F', k, '", "ph": "', k, '.5"}, {"formula": null, "ph": 7}]}}') WHEN 1 THEN concat('{"experiments": [{"formula": "G", "ph": "acid', k, '"}, ', k, ']}')
  WHEN 2 THEN concat('[{"formula": ', k, '}]') WHEN 3 THEN '{"other": []}' ELSE concat('{"extracted_data": {"experiments": [') END AS value
FROM (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR(20)) AS k FROM {{orders}}) o
"""


def q79_extraction_source(spark, sf_dir):
    """Extractions written as lines to the shared folder and read by the library's data source."""
    folder = shared_folder(spark, "extractions")
    fixture(spark, sf_dir, _WRITTEN).select("value").write.text(folder)
    extraction_source.register(spark)
    rows = spark.read.format("extractions").option("fields", '{"formula": "str!", "ph": "float"}').option("suffix", ".txt").option("lines", "true").load(folder)
    return rows.groupBy("pos", "formula", "ph", F.col("_problem").alias("problem")).agg(F.count(F.lit(1)).alias("n"), F.count("_corrupt").alias("corrupt"))


def q54_sessions(spark, sf_dir):
    return protection.sessions(table(spark, sf_dir, "events"), "12 hours")


QUERIES = {f.__name__: f for f in (
    q40_rule_groups, q41_rule_ids, q42_review_policy, q43_rule_merge, q44_latest_run, q45_best_run, q46_compared_runs, q46b_versions, q47_circuit_breaker,
    q48_rate_limit, q49_ring_history, q50_first_object, q51_tolerant_json, q53_stream_tumbling, q54_sessions, q49b_streamed_ring, q78_cached_rows, q79_extraction_source,
)}
_CONSENSUS = f"""
WITH s AS (SELECT *, lower(regexp_replace(text, '\\s+', '', 'g')) AS nt FROM ({plain(_SEEN)})), g AS (
  SELECT scope, field, min(pos) AS pos, count(*) AS evidence, count(DISTINCT nt) AS variants, list({{'doc': doc, 'text': text, 'nt': nt}} ORDER BY pos) AS l FROM s GROUP BY scope, field
), c AS (
  SELECT scope, field, pos, evidence, CASE WHEN variants = 1 THEN 'rule' ELSE 'discrepancy' END AS kind, l[1].text AS text, list_filter(l, lambda x: x.nt <> l[1].nt)[1].text AS other_text,
    array_to_string(list_transform(l[1:3], lambda x: x.text), ' / ') AS examples, l FROM g
), docs AS (SELECT scope, field, doc, min(pos) AS p FROM s GROUP BY scope, field, doc),
fewer AS (SELECT scope, field, string_agg(CAST(doc AS VARCHAR), ',' ORDER BY p) AS documents FROM (SELECT *, row_number() OVER (PARTITION BY scope, field ORDER BY p) AS r FROM docs) WHERE r <= 5 GROUP BY scope, field)
"""
_RUN = f"WITH r AS ({plain(_RUNS)})"
ORACLES = {
    "q40_rule_groups": _CONSENSUS + "SELECT scope, field, pos, evidence, kind, text, other_text, examples, documents FROM c JOIN fewer USING (scope, field)",
    "q41_rule_ids": _CONSENSUS + "SELECT scope, field, kind, scope || CASE WHEN kind = 'rule' THEN '_' ELSE '_disc_' END || (row_number() OVER (PARTITION BY scope, kind ORDER BY pos) - 1) AS id FROM c",
    "q42_review_policy": f"""WITH d AS (SELECT *, CASE WHEN action = 'majority' THEN CASE WHEN ratio >= 0.5 THEN 'a' ELSE 'b' END ELSE action END AS taken FROM ({plain(_OPEN)})),
r AS (SELECT *, CASE taken WHEN 'a' THEN text WHEN 'b' THEN other_text WHEN 'custom' THEN nullif(trim(custom), '') END AS rule_text FROM d)
SELECT 'rule_resolved_' || id AS id, rule_text, CAST(CASE WHEN taken = 'custom' THEN 1 ELSE greatest(1, floor((CASE WHEN taken = 'a' THEN ratio ELSE 1 - ratio END) * evidence)) END AS BIGINT) AS evidence FROM r WHERE rule_text IS NOT NULL""",
    "q43_rule_merge": """WITH k AS (SELECT 'r' || p_partkey AS id, p_name AS rule_text, p_partkey AS pos FROM part), n AS (SELECT 'r' || (event_id % 5000) AS id, arg_min(event_type, event_id) AS rule_text, min(event_id) + 100000 AS pos FROM events GROUP BY 1)
SELECT * FROM k UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM k)""",
    "q44_latest_run": _RUN + "SELECT task, name, created FROM r QUALIFY row_number() OVER (PARTITION BY task ORDER BY created DESC, name) = 1",
    "q45_best_run": _RUN + "SELECT task, name, f1 FROM r WHERE f1 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task ORDER BY f1 DESC, created DESC, name) = 1",
    "q46_compared_runs": _RUN + "SELECT task, name, row_number() OVER (PARTITION BY task ORDER BY CASE WHEN head IS NOT NULL THEN coalesce(f1, 0) END DESC, pos) AS place FROM (SELECT *, first_value(f1) OVER (PARTITION BY task ORDER BY pos) AS head FROM r)",
    "q46b_versions": _RUN + "SELECT task, name, row_number() OVER (PARTITION BY task ORDER BY created, name) AS version FROM r",
    "q48_rate_limit": f"""WITH c AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY key ORDER BY "at", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (row_number() OVER (PARTITION BY key ORDER BY "at", seq) - 1) * 10.0 AS base FROM ({plain(_TIMED)}))
SELECT key, seq, round(base + max("at" - base) OVER (PARTITION BY key ORDER BY "at", seq ROWS UNBOUNDED PRECEDING), 6) AS "start" FROM c""",
    "q49b_streamed_ring": "SELECT user_id AS key, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS age FROM events QUALIFY age <= 20",
    "q78_cached_rows": f"SELECT id, CASE WHEN part < 5 THEN 1 ELSE 2 END::BIGINT AS round, round(price * 2, 2) AS twice FROM ({plain(_LOOKED_UP)})",
    "q79_extraction_source": """WITH o AS (SELECT o_orderkey % 5 AS kind, CAST(o_custkey AS VARCHAR) AS k FROM orders), r(pos, formula, ph, problem, corrupt) AS (
  SELECT 0, 'F' || k, CAST(k || '.5' AS DOUBLE), NULL, 0 FROM o WHERE kind = 0 UNION ALL SELECT 1, NULL, 7, 'formula: missing', 1 FROM o WHERE kind = 0
  UNION ALL SELECT 0, 'G', NULL, 'ph: no float', 1 FROM o WHERE kind = 1 UNION ALL SELECT 1, NULL, NULL, 'record: not an object', 1 FROM o WHERE kind = 1 UNION ALL SELECT 0, k, NULL, NULL, 0 FROM o WHERE kind = 2
  UNION ALL SELECT NULL, NULL, NULL, 'file: ValueError', 1 FROM o WHERE kind = 3 UNION ALL SELECT NULL, NULL, NULL, 'file: JSONDecodeError', 1 FROM o WHERE kind = 4)
SELECT CAST(pos AS BIGINT) AS pos, formula, ph, problem, count(*) AS n, CAST(sum(corrupt) AS BIGINT) AS corrupt FROM r GROUP BY ALL""",
    "q49_ring_history": "SELECT user_id AS key, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS age FROM events QUALIFY age <= 20",
    "q50_first_object": f"SELECT event_id, CASE event_id % 7 WHEN 6 THEN said[:-8] ELSE nullif(regexp_extract(said, '\\{{[^{{}}]*\\}}'), '') END AS found FROM ({plain(_SAID)})",
    "q51_tolerant_json": f"SELECT event_id, CASE WHEN event_id % 7 NOT IN (4, 6) THEN CAST(nullif(regexp_extract(said, '\"k\": *([0-9]+)', 1), '') AS BIGINT) END AS k FROM ({plain(_SAID)})",
    "q53_stream_tumbling": "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS \"start\", event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "q54_sessions": """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS "start", count(*) AS n FROM g GROUP BY user_id, k""",
}
