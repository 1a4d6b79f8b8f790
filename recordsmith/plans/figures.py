"""Queries of figures, anchors, boxes and tables, over parts, pages, events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.text import canonical_ref, page_list
from ..operators import visual as ops
from .base import fixture, plain, rounded, table

_FIGURES = """
SELECT p_brand AS doc, p_partkey AS pos, concat('Fig ', CAST(p_size % 7 AS VARCHAR(5))) AS figure, CAST(p_size % 5 AS VARCHAR(5)) AS page1, CAST(p_size % 3 AS VARCHAR(5)) AS page2,
  concat(p_name, ' ', p_type) AS caption, p_partkey % 3 = 0 AS numeric_, CASE p_partkey % 4 WHEN 0 THEN 'likely' WHEN 1 THEN ' Unlikely' WHEN 2 THEN 'possible' ELSE 'other' END AS relevance
FROM {{part}}
"""
_ANCHORS = "SELECT p_brand AS doc, concat(' FIG  ', CAST(p_size % 9 AS VARCHAR(5))) AS label FROM {{part}} WHERE p_partkey % 40 = 3"
COMMENT = r"<!-- ad (\d+) -->"


def manifest(spark, sf_dir):
    rows = fixture(spark, sf_dir, _FIGURES).withColumnRenamed("numeric_", "numeric")
    return ops.merged_manifest(rows.withColumn("pages", page_list(F.array("page1", "page2", F.lit("x")))))


def anchors(spark, sf_dir):
    return fixture(spark, sf_dir, _ANCHORS).select("doc", canonical_ref(F.col("label")).alias("ref"))


def targets(spark, sf_dir):
    return ops.gated_targets(manifest(spark, sf_dir), anchors(spark, sf_dir))


def q26_manifest_merge(spark, sf_dir):
    return manifest(spark, sf_dir).withColumn("pages", F.array_join(F.transform("pages", lambda x: x.cast("string")), ","))


def q28_route(spark, sf_dir):
    return manifest(spark, sf_dir).groupBy("routing", "relevance").agg(F.count(F.lit(1)).alias("n"))


def q27_panel_rollup(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_quantity") > 25).alias("numeric"), F.element_at(F.array(*map(F.lit, ("", *ops.RELEVANCE))), (F.col("l_partkey") % 4 + 1).cast("int")).alias("relevance"))).alias("panels"))
    rows = lines.select(F.col("l_orderkey").alias("doc"), (F.col("l_orderkey") % 5 == 0).alias("numeric"), F.lit("possible").alias("relevance"), "panels")
    return ops.panel_rollup(rows).drop("panels")


def _comments(spark, sf_dir):
    return ops.spans(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.col("html").alias("text")), COMMENT)


def q29_anchor_scan(spark, sf_dir):
    return _comments(spark, sf_dir).select("doc", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("groups")[0].alias("label"))


def q29b_several_anchors(spark, sf_dir):
    """Each page once more behind two marks of its own, one of them over several lines."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.concat(F.lit("<b k=1\nj='é'><b>"), F.regexp_replace("html", "[<>]", "|"), F.lit("<b k=22>")).alias("text"))
    return ops.spans(pages, r"<b( k=(\d+))?.*?>").select("doc", F.col("pos").cast("long").alias("pos"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.array_join("groups", "/").alias("groups"))


_MARKS = """
SELECT user_id AS doc, event_id AS pos, CASE WHEN event_id % 3 = 0 THEN 'END' ELSE 'BEGIN' END AS kind, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE concat('Fig ', CAST(CAST(floor(event_id / 4) AS BIGINT) % 3 AS VARCHAR(5))) END AS label,
  event_id * 10 AS start_, event_id * 10 + 5 AS end_ FROM {{events}}
"""


def _blocks(spark, sf_dir):
    marks = fixture(spark, sf_dir, _MARKS).withColumnsRenamed({"start_": "start", "end_": "end"})
    return ops.paired_blocks(marks)


def q30_block_pairing(spark, sf_dir):
    return _blocks(spark, sf_dir)


def q31_anchor_duplicates(spark, sf_dir):
    unique = ops.unique_refs(_blocks(spark, sf_dir).where("outcome = 'block'"), "doc")
    return unique.groupBy("occurrences").agg(F.count(F.lit(1)).alias("anchors"))


def q32_targets(spark, sf_dir):
    return targets(spark, sf_dir)


def q33_gate_report(spark, sf_dir):
    return ops.gate_report(manifest(spark, sf_dir), anchors(spark, sf_dir), targets(spark, sf_dir))


def q34_table_render(spark, sf_dir):
    cells = F.array(F.col("l_partkey").cast("string"), F.concat(F.lit(" a|b  "), F.col("l_returnflag")), F.col("l_linestatus"))
    row = F.slice(cells, F.lit(1), F.when(F.col("l_partkey") % 4 == 0, 1).when(F.col("l_partkey") % 4 == 1, 3).otherwise(2))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), row.alias("r")))).alias("rows"))
    lines = lines.withColumn("rows", F.transform("rows", lambda x: x["r"])).withColumn("columns", F.array(F.struct(F.lit("part").alias("name"), F.lit("id").alias("unit")), F.struct(F.lit("flag").alias("name"), F.lit("").alias("unit"))))
    return lines.select("doc", ops.rendered_table(F.col("columns"), F.col("rows")).alias("table_text"), ops.ragged(F.col("columns"), F.col("rows")).cast("long").alias("ragged"))


def q35_insert_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.col("html").alias("text"))
    places = _comments(spark, sf_dir).select("doc", F.col("start").alias("content_start"), F.col("end").alias("content_end"), F.concat(F.lit("| ad "), F.col("groups")[0], F.lit(" |")).alias("body"))
    return ops.inserted(docs, places).select("doc", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n"))


def _report(spark, sf_dir):
    t = targets(spark, sf_dir).where("outcome = 'target'")
    digit = F.substring(F.md5(F.concat("doc", "target_id")), 1, 1)
    crops = t.where(digit != "0").select("doc", "target_id", F.when(digit < "4", "failed").otherwise("success").alias("status"))
    tables = t.where(digit >= "4").select("doc", "target_id", F.when(digit == "9", "partial").otherwise("success").alias("status"))
    return ops.visual_report(manifest(spark, sf_dir), targets(spark, sf_dir), crops, tables)


def q36_visual_report(spark, sf_dir):
    return _report(spark, sf_dir)


def q37_report_summary(spark, sf_dir):
    return ops.report_summary(_report(spark, sf_dir))


_BOXES = """
SELECT l_orderkey AS doc, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_discount AS x0, l_discount + l_quantity / 60 AS x1, l_tax AS y0, l_tax + l_quantity / 55 AS y1,
  CAST(200 + l_partkey % 2000 AS INT) AS width, CAST(300 + l_suppkey % 1500 AS INT) AS height FROM {{lineitem}}
"""


def q38_bbox_geometry(spark, sf_dir):
    rows = fixture(spark, sf_dir, _BOXES).withColumn("box", F.array("x0", "y0", "x1", "y1"))
    pixels, grown = geo.to_pixels(F.col("box"), F.col("width"), F.col("height")), geo.with_margin(F.col("box"), 0.05)
    out = rows.where(geo.valid_box(F.col("box"))).select("doc", "line", "part", "supp", pixels.alias("px"), grown.alias("grown"), geo.area_share(F.col("box")).alias("share"), geo.area_warnings(F.col("box")).alias("w"))
    out = out.groupBy("doc").agg(F.count(F.lit(1)).alias("boxes"), F.sum(F.col("px")[2] - F.col("px")[0]).alias("widths"), F.sum("share").alias("share"), F.sum(F.col("grown")[3]).alias("bottoms"), F.sum(F.size("w")).alias("warnings"))
    return rounded(out, "share", "bottoms")


def q39_image_tokens(spark, sf_dir):
    return fixture(spark, sf_dir, _BOXES).groupBy("width", "height").agg(F.max(geo.image_tokens(F.col("width"), F.col("height"))).alias("tokens"))


def q84_model_image_tokens(spark, sf_dir):
    rows = fixture(spark, sf_dir, _BOXES).withColumn("class", F.element_at(F.array(*[F.lit(x) for x in (" LOW", "ultra-high", "default", "medium", None, "tiny", "High")]), (F.col("part") % 7 + 1).cast("int")))
    tokens = geo.model_image_tokens(F.col("width"), F.col("height"), F.col("supp") % 2 == 0, F.col("class"))
    return rows.withColumn("tokens", tokens).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), F.count("tokens").alias("known"))


def q52_panel_filter(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    name = lambda n: F.when(n == 0, "").otherwise(F.concat(F.lit("(P"), n.cast("string"), F.lit(")")))
    rows = lines.groupBy(F.col("l_orderkey").alias("doc")).agg(
        F.array_sort(F.collect_set(F.struct(name(F.col("l_linenumber") % 3).alias("panel"), (F.col("l_partkey") % 2 == 0).alias("numeric"), F.lit("likely").alias("relevance")))).alias("panels"),
        F.array_sort(F.collect_list(F.struct(name(F.col("l_partkey") % 4).alias("panel"), F.col("l_partkey").alias("id")))).alias("tables"),
    )
    out = ops.allowed_tables(rows.withColumn("status", F.lit("success")))
    return out.select("doc", "status", F.size("tables").cast("long").alias("kept"), F.array_join(F.array_sort("missing_panels"), ",").alias("missing"))


QUERIES = {f.__name__: f for f in (
    q26_manifest_merge, q27_panel_rollup, q28_route, q29_anchor_scan, q29b_several_anchors, q30_block_pairing, q31_anchor_duplicates, q32_targets, q33_gate_report, q34_table_render,
    q35_insert_tables, q36_visual_report, q37_report_summary, q38_bbox_geometry, q39_image_tokens, q52_panel_filter, q84_model_image_tokens,
)}
_RANK = "CASE lower(trim({0})) WHEN 'unlikely' THEN 1 WHEN 'possible' THEN 2 WHEN 'likely' THEN 3 ELSE 0 END"
_NAME = "CASE {0} WHEN 1 THEN 'unlikely' WHEN 2 THEN 'possible' WHEN 3 THEN 'likely' ELSE '' END"
_ROUTE = "CASE WHEN NOT numeric_ THEN 'skip_not_numeric' WHEN relevance = 'unlikely' THEN 'skip_unlikely' ELSE 'extract' END"
_M = f"""
WITH f AS ({plain(_FIGURES)}), g AS (
  SELECT doc, figure, min(pos) AS pos, list_sort(list_distinct(flatten(list([page1::INT, page2::INT])))) AS pages, arg_max(caption, [length(caption), -pos]) AS caption, bool_or(numeric_) AS numeric_, max({_RANK.format('relevance')}) AS rank, count(*) AS merged FROM f GROUP BY doc, figure
), named AS (SELECT *, {_NAME.format('rank')} AS relevance FROM g), m AS (SELECT *, {_ROUTE} AS routing FROM named),
a AS (SELECT doc, trim(regexp_replace(lower(label), '\\s+', ' ', 'g')) AS ref FROM ({plain(_ANCHORS)})), n AS (SELECT doc, ref, count(*) AS n FROM a GROUP BY doc, ref),
placed AS (SELECT *, lower(figure) AS ref, 'target_' || lpad(CAST(row_number() OVER (PARTITION BY doc ORDER BY pos) AS VARCHAR), 4, '0') AS target_id FROM m),
t AS (SELECT p.doc, p.target_id, p.ref, CASE WHEN n IS NULL THEN 'skipped_no_anchor' WHEN n > 1 THEN 'skipped_duplicate' ELSE 'target' END AS outcome FROM placed p LEFT JOIN n USING (doc, ref) WHERE routing = 'extract'),
d AS (SELECT doc, target_id, ref, substr(md5(doc || target_id), 1, 1) AS digit FROM t WHERE outcome = 'target'),
r AS (SELECT m.doc, m.figure, m.routing, d.target_id, CASE WHEN digit <> '0' THEN CASE WHEN digit < '4' THEN 'failed' ELSE 'success' END END AS crop_status,
  CASE WHEN digit >= '4' THEN CASE WHEN digit = '9' THEN 'partial' ELSE 'success' END END AS table_status, caption FROM m LEFT JOIN d ON d.doc = m.doc AND d.ref = lower(m.figure)),
report AS (SELECT doc, figure, routing, target_id, crop_status, table_status, CASE WHEN routing <> 'extract' THEN routing WHEN target_id IS NULL THEN 'no_target' WHEN coalesce(crop_status, '') <> 'success' THEN 'crop_failed' WHEN coalesce(table_status, '') <> 'success' THEN 'extraction_failed' END AS skip_reason,
  CASE WHEN length(caption) > 40 THEN substr(caption, 1, 37) || '...' ELSE caption END AS caption FROM r)
"""
_PAIRED = f"""
WITH m AS (SELECT *, trim(lower(label)) AS ref FROM ({plain(_MARKS)})), w AS (
  SELECT *, lead(kind) OVER o AS nk, lead(ref) OVER o AS nr, lag(kind) OVER o AS bk, lag(ref) OVER o AS br, lead(start_) OVER o AS ns, lead(end_) OVER o AS ne FROM m WINDOW o AS (PARTITION BY doc ORDER BY pos)
), p AS (
  SELECT doc, pos, ref, CASE WHEN kind = 'BEGIN' THEN CASE WHEN ref = '' THEN 'empty_begin_label' WHEN nk IS NULL THEN 'missing_end' WHEN nk = 'BEGIN' THEN 'nested_or_missing_end' WHEN nr <> ref THEN 'label_mismatch' ELSE 'block' END ELSE 'unmatched_end' END AS outcome,
    start_ AS "start", end_ AS content_start, ns, ne, end_ FROM w WHERE NOT coalesce(kind = 'END' AND bk = 'BEGIN' AND br <> '', false)
), b AS (SELECT doc, pos, ref, outcome, "start", content_start, CASE WHEN outcome IN ('block', 'label_mismatch') THEN ns END AS content_end, CASE WHEN outcome IN ('block', 'label_mismatch') THEN ne ELSE end_ END AS "end" FROM p)
"""
ORACLES = {
    "q26_manifest_merge": _M + "SELECT doc, figure, pos, array_to_string(pages, ',') AS pages, caption, numeric_ AS numeric, relevance, merged, routing FROM m",
    "q28_route": _M + "SELECT routing, relevance, count(*) AS n FROM m GROUP BY routing, relevance",
    "q27_panel_rollup": f"""WITH g AS (SELECT l_orderkey AS doc, l_orderkey % 5 = 0 AS own, bool_or(l_quantity > 25) AS high, greatest(2, max(l_partkey % 4)) AS rank FROM lineitem GROUP BY l_orderkey)
SELECT doc, own OR high AS numeric, {_NAME.format('rank')} AS relevance, high AND NOT own AS raised_numeric, rank > 2 AS raised_relevance FROM g""",
    "q29_anchor_scan": """WITH h AS (SELECT page_id AS doc, html, regexp_extract(html, '<!-- ad [0-9]+ -->') AS hit, regexp_extract(html, '<!-- ad ([0-9]+) -->', 1) AS label FROM pages)
SELECT doc, CAST(instr(html, hit) - 1 AS BIGINT) AS "start", CAST(instr(html, hit) - 1 + length(hit) AS BIGINT) AS "end", label FROM h WHERE hit <> ''""",
    "q29b_several_anchors": """WITH p AS (SELECT page_id AS doc, length(html) AS n FROM pages)
SELECT doc, 0 AS pos, 0 AS "start", 13 AS "end", ' k=1/1' AS groups FROM p UNION ALL SELECT doc, 1, 13, 16, '/' FROM p UNION ALL SELECT doc, 2, 16 + n, 24 + n, ' k=22/22' FROM p""",
    "q30_block_pairing": _PAIRED + "SELECT * FROM b",
    "q31_anchor_duplicates": _PAIRED + "SELECT occurrences, CAST(sum(occurrences) AS BIGINT) AS anchors FROM (SELECT doc, ref, count(*) AS occurrences FROM b WHERE outcome = 'block' GROUP BY doc, ref) GROUP BY occurrences",
    "q32_targets": _M + "SELECT * FROM t",
    "q33_gate_report": _M + "SELECT doc, outcome, count(*) AS n FROM (SELECT doc, outcome FROM t UNION ALL SELECT doc, 'anchor_without_figure' FROM (SELECT DISTINCT doc, ref FROM a EXCEPT SELECT doc, lower(figure) FROM m)) GROUP BY doc, outcome",
    "q34_table_render": """SELECT l_orderkey AS doc, '| part (id) | flag |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || l_partkey || ' | ' || CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'a\\|b ' || l_returnflag END || ' |', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS table_text,
  count(*) FILTER (l_partkey % 4 < 2) AS ragged FROM lineitem GROUP BY l_orderkey""",
    "q35_insert_tables": """WITH h AS (SELECT page_id AS doc, html, regexp_extract(html, '<!-- ad [0-9]+ -->') AS hit, regexp_extract(html, '<!-- ad ([0-9]+) -->', 1) AS label FROM pages),
i AS (SELECT doc, CASE WHEN hit = '' THEN html ELSE substr(html, 1, instr(html, hit) - 1) || chr(10) || '| ad ' || label || ' |' || chr(10) || substr(html, instr(html, hit) + length(hit)) END AS t FROM h)
SELECT doc, md5(t) AS text_md5, CAST(length(t) AS BIGINT) AS n FROM i""",
    "q36_visual_report": _M + "SELECT * FROM report",
    "q37_report_summary": _M + "SELECT count(*) AS figures, count(target_id) AS targets, count(*) FILTER (crop_status = 'success') AS cropped, count(*) FILTER (table_status = 'success') AS extracted, count(skip_reason) AS skipped FROM report",
    "q38_bbox_geometry": f"""WITH b AS (SELECT * FROM ({plain(_BOXES)}) WHERE x0 >= 0 AND x0 < x1 AND x1 <= 1 AND y0 >= 0 AND y0 < y1 AND y1 <= 1)
SELECT doc, count(*) AS boxes, CAST(sum(round_even(x1 * width, 0) - round_even(x0 * width, 0)) AS BIGINT) AS widths, round(sum((x1 - x0) * (y1 - y0)), 6) AS share, round(sum(least(y1 + (y1 - y0) * 0.05, 1)), 6) AS bottoms,
  CAST(sum(((x1 - x0) * (y1 - y0) < 0.01)::INT + ((x1 - x0) * (y1 - y0) > 0.95)::INT + (x0 <= 0 OR y0 <= 0 OR x1 >= 1 OR y1 >= 1)::INT) AS BIGINT) AS warnings FROM b GROUP BY doc""",
    "q84_model_image_tokens": f"""WITH b AS (SELECT *, [' LOW', 'ultra-high', 'default', 'medium', NULL, 'tiny', 'High'][part % 7 + 1] AS class FROM ({plain(_BOXES)})),
t AS (SELECT *, CASE WHEN part % 7 = 5 THEN NULL WHEN supp % 2 = 0 THEN [280, 2240, 1120, 560, 1120, NULL, 1120][part % 7 + 1] WHEN width <= 384 AND height <= 384 THEN 258 ELSE ceil(width / 768) * ceil(height / 768) * 258 END AS tokens FROM b)
SELECT class, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens, count(tokens) AS known FROM t GROUP BY class""",
    "q39_image_tokens": f"SELECT width, height, CAST(max(CASE WHEN width <= 384 AND height <= 384 THEN 258 ELSE ceil(width / 768) * ceil(height / 768) * 258 END) AS BIGINT) AS tokens FROM ({plain(_BOXES)}) GROUP BY width, height",
    "q52_panel_filter": """WITH l AS (SELECT l_orderkey AS doc, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'p' || (l_linenumber % 3) END AS own, l_partkey % 2 = 0 AS numeric_, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'p' || (l_partkey % 4) END AS k FROM lineitem),
a AS (SELECT doc, coalesce(list(DISTINCT own) FILTER (numeric_), []) AS allowed FROM l GROUP BY doc), t AS (SELECT doc, allowed, CASE WHEN len(allowed) = 1 AND k = '' THEN allowed[1] ELSE k END AS k FROM l JOIN a USING (doc)),
d AS (SELECT doc, any_value(allowed) AS allowed, count(*) FILTER (len(allowed) = 0 OR list_contains(allowed, k)) AS kept, list(DISTINCT k) AS ks FROM t GROUP BY doc), m AS (SELECT *, list_sort(list_filter(allowed, lambda x: NOT list_contains(ks, x))) AS missing FROM d)
SELECT doc, CASE WHEN len(allowed) = 0 THEN 'success' WHEN kept = 0 THEN 'no_extractable_chart' WHEN len(missing) > 0 THEN 'partial' ELSE 'success' END AS status, kept, array_to_string(missing, ',') AS missing FROM m""",
}
