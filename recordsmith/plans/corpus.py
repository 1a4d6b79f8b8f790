"""Queries of documents, splits and ground truth, over parts, documents, labels and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import document_key
from ..operators import corpus as ops
from ..operators.tasks import Registry
from .base import fixture, plain, rounded, table

_RAW = """
SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN '' WHEN p_partkey % 10 = 0 THEN NULL ELSE p_name END AS formula, CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS "material",
  CASE p_partkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN CAST(p_size AS VARCHAR(10)) WHEN 2 THEN concat(CAST(p_size AS VARCHAR(10)), '.5') ELSE CAST(p_size * 2 AS VARCHAR(10)) END AS size_nm,
  p_type AS activity, CASE p_partkey % 3 WHEN 0 THEN 'TRUE' WHEN 1 THEN '1' ELSE 'no' END AS checked
FROM {{part}}
"""
ACTIVITIES = ("ECONOMY", "SMALL", "STANDARD")
TASK = ops.Task("parts", (
    ops.Field("formula", required=True, columns=("formula", "material")), ops.Field("length", "float", columns=("length", "size_nm"), low=0, high=60),
    ops.Field("count", "int", columns=("size_nm",)), ops.Field("activity", choices=ACTIVITIES), ops.Field("checked", "bool"),
))


def _spark_raw(spark, sf_dir):
    return fixture(spark, sf_dir, _RAW.replace('"', "`"))


def q13_row_convert(spark, sf_dir):
    rows = ops.converted(_spark_raw(spark, sf_dir), TASK, ["id"])
    return rows.where("problem is null").drop("problem")


def q13b_sql_conversion(spark, sf_dir):
    """The same by the SQL functions that a registered task gives the session."""
    registry = Registry(spark)
    registry.register(TASK)
    rows = registry.converted(_spark_raw(spark, sf_dir), TASK.name, ["id"])
    return rows.where("problem is null").drop("problem")


def q14_reject_report(spark, sf_dir):
    return ops.converted(_spark_raw(spark, sf_dir), TASK, ["id"]).where("problem is not null").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


_FILES = "SELECT doc_id, concat(source, CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' ELSE '.txt' END) AS raw, lang FROM {{documents}}"


_HOT = "SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN 'Hot.pdf' WHEN doc_id % 3 = 1 THEN concat(source, '.txt') ELSE source END AS raw FROM {{documents}}"


def q15_group_last_wins(spark, sf_dir):
    rows = fixture(spark, sf_dir, _FILES)
    got = ops.grouped_last_wins(rows, "raw", document_key(F.col("raw")), "doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), "lang"))
    return got.select("key", "raw", "n", F.array_join("records", ",").alias("records"))


def q15b_group_chunks(spark, sf_dir):
    """One key holds a third of all rows."""
    rows = fixture(spark, sf_dir, _HOT)
    got = ops.grouped_in_chunks(rows, "raw", document_key(F.col("raw")), "doc_id", F.col("lang"), 50)
    return got.select("key", "raw_id", "chunk", "first", "n", "chunks", "total", F.array_join("values", ",").alias("records"))


def q16_coverage(spark, sf_dir):
    return rounded(ops.coverage(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").where("n_chars > 1000"), "doc_id"), "percentage")


def q17_compared_counts(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").where("l_partkey % 3 <> 0").select(F.col("l_orderkey").alias("doc"))
    gold = table(spark, sf_dir, "lineitem").where("l_partkey % 4 <> 0").select(F.col("l_orderkey").alias("doc"))
    return ops.compared_counts(found, gold, "doc")


_SPLITS = """
SELECT CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split, doc_id FROM {{documents}}
UNION ALL SELECT 'val' AS split, doc_id FROM {{documents}} WHERE doc_id % 37 = 0
UNION ALL SELECT 'manual' AS split, doc_id + 5 AS doc_id FROM {{labels}}
"""


def q18_split_validation(spark, sf_dir):
    return ops.split_report(fixture(spark, sf_dir, _SPLITS), table(spark, sf_dir, "labels"), "doc_id")


def q19_split_overlap(spark, sf_dir):
    return ops.split_overlap(fixture(spark, sf_dir, _SPLITS), "doc_id")


def q20_unused_documents(spark, sf_dir):
    used = fixture(spark, sf_dir, _SPLITS).where("split = 'manual'")
    return table(spark, sf_dir, "documents").select("doc_id").join(used, "doc_id", "left_anti")


def q21_exact_split(spark, sf_dir):
    return ops.exact_split(table(spark, sf_dir, "documents"), "doc_id", 0.8, 42)


def q22_numeric_profile(spark, sf_dir):
    return rounded(ops.numeric_profile(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"]), "low", "high", "median")


def q23_top_values(spark, sf_dir):
    return ops.top_values(table(spark, sf_dir, "part"), "p_brand", 10).select(F.col("rank").cast("long").alias("rank"), "value", "n")


def q23b_value_tail(spark, sf_dir):
    return ops.value_tail(table(spark, sf_dir, "part"), "p_brand", 10, 5, 7)


def q24_dataset_statistics(spark, sf_dir):
    """Each conversation is an example with the text of all its turns, which are its records; sentences are counted besides."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "")
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.when(F.count("text") > 0, said).alias("text"), F.count(F.lit(1)).alias("records"))
    statistics = ops.dataset_statistics(whole, "text", F.col("records"), sentences=F.size(F.split("text", r"\.")))
    return rounded(statistics, "average_length", "average_records", "average_sentences")


def q25_gold_statistics(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"))
    return rounded(ops.gold_statistics(orders, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc")), "doc"), "average")


def q25b_seeded_limit(spark, sf_dir):
    return ops.seeded_limit(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 50, 42)


QUERIES = {f.__name__: f for f in (
    q13_row_convert, q13b_sql_conversion, q14_reject_report, q15_group_last_wins, q15b_group_chunks, q16_coverage, q17_compared_counts, q18_split_validation, q19_split_overlap, q20_unused_documents,
    q21_exact_split, q22_numeric_profile, q23_top_values, q23b_value_tail, q24_dataset_statistics, q25_gold_statistics, q25b_seeded_limit,
)}
_CONVERTED = f"""
WITH raw AS ({plain(_RAW)}), typed AS (
  SELECT id, coalesce(nullif(formula, ''), nullif(material, '')) AS formula, CASE WHEN regexp_matches(size_nm, '^[0-9.]+$') THEN try_cast(size_nm AS DOUBLE) END AS length,
    CASE WHEN regexp_matches(size_nm, '^[0-9]+$') THEN try_cast(size_nm AS BIGINT) END AS count, activity, lower(checked) IN ('true', '1', 'yes') AS checked FROM raw
), judged AS (
  SELECT *, CASE WHEN formula IS NULL THEN 'formula: missing' WHEN length < 0 OR length > 60 THEN 'length: out of range'
    WHEN activity NOT IN {ACTIVITIES} THEN 'activity: not a choice' END AS problem FROM typed
)
"""
_COUNTS = "SELECT l_orderkey AS doc, count(*) AS {} FROM lineitem WHERE l_partkey % {} <> 0 GROUP BY 1"
ORACLES = {
    "q13_row_convert": _CONVERTED + "SELECT id, formula, length, count, activity, checked FROM judged WHERE problem IS NULL",
    "q13b_sql_conversion": _CONVERTED + "SELECT id, formula, length, count, activity, checked FROM judged WHERE problem IS NULL",
    "q14_reject_report": _CONVERTED + "SELECT problem, count(*) AS n FROM judged WHERE problem IS NOT NULL GROUP BY problem",
    "q15_group_last_wins": f"""WITH r AS (SELECT *, regexp_replace(lower(trim(raw)), '\\.(pdf|txt|doc)$', '') AS key FROM ({plain(_FILES)})), l AS (SELECT key, max(raw) AS raw FROM r GROUP BY key)
SELECT key, raw, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR) || ':' || lang, ',' ORDER BY doc_id) AS records FROM r JOIN l USING (key, raw) GROUP BY key, raw""",
    "q15b_group_chunks": f"""WITH r AS (SELECT *, regexp_replace(lower(trim(raw)), '\\.(pdf|txt|doc)$', '') AS key FROM ({plain(_HOT)})), l AS (SELECT key, max(raw) AS raw FROM r GROUP BY key),
p AS (SELECT key, raw, doc_id, lang, row_number() OVER w AS i, count(*) OVER (PARTITION BY key) AS total FROM r JOIN l USING (key, raw) WINDOW w AS (PARTITION BY key ORDER BY doc_id, lang))
SELECT key, raw AS raw_id, (i - 1) // 50 AS chunk, (i - 1) // 50 * 50 + 1 AS first, count(*) AS n, (total + 49) // 50 AS chunks, total, string_agg(lang, ',' ORDER BY i) AS records FROM p GROUP BY key, raw, (i - 1) // 50, total""",
    "q16_coverage": """WITH w AS (SELECT DISTINCT doc_id FROM labels), h AS (SELECT DISTINCT doc_id FROM documents WHERE n_chars > 1000)
SELECT count(*) FILTER (w.doc_id IS NOT NULL AND h.doc_id IS NOT NULL) AS covered, count(*) FILTER (h.doc_id IS NULL) AS missing, count(*) FILTER (w.doc_id IS NULL) AS extra,
  round(coalesce(100.0 * count(*) FILTER (w.doc_id IS NOT NULL AND h.doc_id IS NOT NULL) / nullif(count(*) FILTER (w.doc_id IS NOT NULL), 0), 0), 6) AS percentage FROM w FULL JOIN h ON w.doc_id = h.doc_id""",
    "q17_compared_counts": f"""WITH f AS ({_COUNTS.format('found', 3)}), g AS ({_COUNTS.format('gold', 4)})
SELECT coalesce(f.doc, g.doc) AS doc, coalesce(found, 0) AS found, coalesce(gold, 0) AS gold, coalesce(found, 0) - coalesce(gold, 0) AS difference,
  CASE WHEN gold IS NULL THEN 'extra' WHEN found IS NULL THEN 'missing' WHEN found = gold THEN 'matched' ELSE 'different' END AS status FROM f FULL JOIN g ON f.doc = g.doc""",
    "q18_split_validation": f"""SELECT split, count(*) AS n, count(*) FILTER (l.doc_id IS NULL) AS missing, count(*) FILTER (l.doc_id IS NULL) = 0 AS valid
FROM (SELECT DISTINCT * FROM ({plain(_SPLITS)})) s LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = s.doc_id GROUP BY split""",
    "q19_split_overlap": f"SELECT doc_id, string_agg(split, ',' ORDER BY split) AS splits FROM (SELECT DISTINCT * FROM ({plain(_SPLITS)}) WHERE split IN ('train', 'val', 'test')) GROUP BY doc_id HAVING count(*) > 1",
    "q20_unused_documents": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id + 5 FROM labels)",
    "q21_exact_split": """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) <= floor((SELECT count(DISTINCT doc_id) FROM documents) * 0.8) THEN 'train' ELSE 'test' END AS split
FROM (SELECT DISTINCT doc_id FROM documents)""",
    "q22_numeric_profile": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(CAST(min({c}) AS DOUBLE), 6) AS low, round(CAST(max({c}) AS DOUBLE), 6) AS high, round(CAST(median({c}) AS DOUBLE), 6) AS median FROM part" for c in ("p_size", "p_retailprice")),
    "q23_top_values": "SELECT row_number() OVER (ORDER BY n DESC, value) AS rank, value, n FROM (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10)",
    "q23b_value_tail": """WITH c AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1), t AS (SELECT value FROM c ORDER BY n DESC, value LIMIT 10)
SELECT value, n FROM c WHERE value NOT IN (SELECT value FROM t) ORDER BY md5(value || '|7'), value LIMIT 5""",
    "q24_dataset_statistics": """SELECT count(*) AS examples, round(avg(length(text)), 6) AS average_length, round(avg(records), 6) AS average_records, round(avg(len(string_split(text, '.'))), 6) AS average_sentences
FROM (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, count(*) AS records FROM conversations GROUP BY conv_id)""",
    "q25_gold_statistics": """SELECT count(*) AS documents, count(*) FILTER (coalesce(n, 0) = 0) AS empty_documents, CAST(sum(coalesce(n, 0)) AS BIGINT) AS records, round(avg(coalesce(n, 0)), 6) AS average
FROM (SELECT DISTINCT o_orderkey AS doc FROM orders) LEFT JOIN (SELECT l_orderkey AS doc, count(*) AS n FROM lineitem GROUP BY 1) USING (doc)""",
    "q25b_seeded_limit": "SELECT doc_id, lang FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id LIMIT 50",
}
