"""Queries of findings, counters, insertions, crops, labels and candidate grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.text import figure_slug, scalar_text
from ..operators import reports as ops
from ..operators import scoring
from .base import fixture, plain, rounded, table
from .corpus import _SPLITS
from .evaluation import FIELDS, GOLD, _hit, gold

_WANTED = "SELECT doc_id FROM {{labels}} UNION ALL SELECT doc_id + 1000000 AS doc_id FROM {{labels}} WHERE doc_id % 10 = 0"
_TEXTS = "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '   ' ELSE text END AS text FROM {{documents}}"
_RECORDS = "SELECT doc_id FROM {{labels}} WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id FROM {{labels}} WHERE doc_id % 8 = 1"


def _inputs(spark, sf_dir):
    return [fixture(spark, sf_dir, x) for x in (_WANTED, _TEXTS, _RECORDS)]


def q55_document_inputs(spark, sf_dir):
    return ops.document_inputs(*_inputs(spark, sf_dir), "doc_id").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def q56_analysis_inputs(spark, sf_dir):
    return ops.analysis_inputs(*_inputs(spark, sf_dir), "doc_id")


_CALLS = """
SELECT o_custkey % 50 AS batch, o_orderkey AS pos, CASE WHEN o_orderkey % 211 = 5 THEN 'open' WHEN o_orderkey % 13 = 0 THEN 'failed' WHEN o_orderkey % 7 = 0 THEN 'skipped' ELSE 'success' END AS status
FROM {{orders}}
"""


def q57_batch_counters(spark, sf_dir):
    return ops.batch_counters(ops.stopped_batch(fixture(spark, sf_dir, _CALLS), "batch", "pos", "status"), "batch")


def q58_split_findings(spark, sf_dir):
    return ops.split_findings(fixture(spark, sf_dir, _SPLITS), table(spark, sf_dir, "labels"), "doc_id")


def q58b_merged_findings(spark, sf_dir):
    found = ops.split_findings(fixture(spark, sf_dir, _SPLITS), table(spark, sf_dir, "labels"), "doc_id")
    return ops.merged_findings(found, found.where("rule = 'unused_gold'"))


_SCALARS = """
SELECT CASE l_partkey % 10 WHEN 7 THEN concat(CAST(l_suppkey AS VARCHAR(20)), 'e', CAST(l_linenumber AS VARCHAR(5))) WHEN 8 THEN concat('-', CAST(l_linenumber AS VARCHAR(5)), '.25E-', CAST(l_linenumber + 4 AS VARCHAR(5))) WHEN 9 THEN '-0.0' WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN CAST(l_suppkey AS VARCHAR(20)) WHEN 3 THEN concat(CAST(l_suppkey AS VARCHAR(20)), '.0')
  WHEN 4 THEN concat('-0.', CAST(l_suppkey + 1 AS VARCHAR(20)), '5') WHEN 5 THEN 'null' ELSE concat('"', l_returnflag, ' ', CAST(l_suppkey AS VARCHAR(20)), '"') END AS raw
FROM {{lineitem}}
"""


def q59_scalar_text(spark, sf_dir):
    rows = fixture(spark, sf_dir, _SCALARS)
    return rows.groupBy("raw", scalar_text(F.col("raw")).alias("text")).agg(F.count(F.lit(1)).alias("n"))


_LABELS = """
SELECT p_partkey AS id, concat(CASE p_partkey % 4 WHEN 0 THEN ' Supplementary ' WHEN 1 THEN 'Supp. ' WHEN 2 THEN 'Extended  Data ' ELSE '' END, CASE p_partkey % 3 WHEN 0 THEN 'Figure ' WHEN 1 THEN 'Fig. ' ELSE 'Figures  ' END,
  CASE p_partkey % 5 WHEN 0 THEN 'S' ELSE '' END, CAST(p_size AS VARCHAR(5)), CASE p_partkey % 6 WHEN 0 THEN '(b)' WHEN 1 THEN ' C' WHEN 2 THEN 'a:' WHEN 3 THEN '.' WHEN 4 THEN ' (d) and' ELSE '' END) AS label
FROM {{part}}
"""


def q60_figure_slug(spark, sf_dir):
    return fixture(spark, sf_dir, _LABELS).select("id", figure_slug(F.col("label")).alias("slug"))


_PARTS = """
SELECT l_orderkey AS target, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS pos,
  l_partkey % 500 + 20 AS width, l_suppkey % 300 + 10 AS height, CAST(l_discount AS DOUBLE) AS share
FROM {{lineitem}}
"""


def q61_crop_composites(spark, sf_dir):
    return rounded(ops.crop_composites(fixture(spark, sf_dir, _PARTS)), "share")


def q62_part_numbers(spark, sf_dir):
    return ops.numbered_parts(fixture(spark, sf_dir, _PARTS)).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("width").alias("width"))


_RESULTS = """
SELECT p_brand AS doc, p_partkey AS pos, concat('t', CAST(p_partkey % 400 AS VARCHAR(5))) AS target_id, CASE p_partkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' WHEN 2 THEN 'crop_failed' ELSE 'success' END AS status,
  p_size % 3 AS tables, CASE WHEN p_partkey % 3 = 0 THEN concat('Fig  ', CAST(p_size AS VARCHAR(5))) END AS visual_ref, CASE WHEN p_partkey % 4 = 0 THEN concat(' FIG ', CAST(p_size AS VARCHAR(5)), ' ') END AS figure
FROM {{part}} WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0
"""
_TARGETS = """
SELECT DISTINCT p_brand AS doc, concat('t', CAST(p_partkey % 400 AS VARCHAR(5))) AS target_id, concat('fig ', CAST(p_partkey % 400 % 50 AS VARCHAR(5))) AS visual_ref, CASE WHEN p_partkey % 400 % 2 = 0 THEN 'Fig 7' END AS figure
FROM {{part}}
"""
_PLACES = "SELECT DISTINCT p_brand AS doc, concat('fig ', CAST(p_size AS VARCHAR(5))) AS ref FROM {{part}} WHERE p_partkey % 7 <> 0"


def _index(spark, sf_dir):
    return ops.result_index(fixture(spark, sf_dir, _RESULTS), fixture(spark, sf_dir, _TARGETS))


def q63_result_index(spark, sf_dir):
    return _index(spark, sf_dir)


def q64_insertions(spark, sf_dir):
    return ops.insertions(fixture(spark, sf_dir, _PLACES), _index(spark, sf_dir))


def q64b_insertion_summary(spark, sf_dir):
    return ops.insertion_summary(ops.insertions(fixture(spark, sf_dir, _PLACES), _index(spark, sf_dir)))


_CHUNKS = "SELECT conv_id, turn, text, turn = conv_id % 5 + 1 AS done FROM {{conversations}}"


def q65_joined_chunks(spark, sf_dir):
    return ops.joined_chunks(fixture(spark, sf_dir, _CHUNKS), "conv_id", "turn", "text", "done").select("conv_id", F.md5("text").alias("text_md5"), "chunks")


_TRIED = f"SELECT c.candidate, g.doc, g.pos, CASE WHEN (g.doc + g.pos) % (c.candidate + 2) = 0 THEN NULL ELSE g.flag END AS flag, g.status, CASE WHEN (g.doc * 7 + g.pos) % (5 - c.candidate) = 0 THEN g.quantity + 1 ELSE g.quantity END AS quantity, g.discount, g.shipped FROM ({GOLD}) g CROSS JOIN (SELECT 0 AS candidate UNION ALL SELECT 1 AS candidate UNION ALL SELECT 2 AS candidate) c WHERE g.doc % 10 <> c.candidate"


def q66_evaluation_grid(spark, sf_dir):
    """Three candidate extractions of every document."""
    tried = fixture(spark, sf_dir, _TRIED)
    candidates = tried.select("candidate").distinct()
    truth = gold(spark, sf_dir).join(F.broadcast(candidates))  # three rows
    scores = scoring.precision_recall(scoring.pair_outcomes(tried, truth, ["candidate", "doc", "pos"], FIELDS), ["candidate", "doc"])
    return rounded(ops.evaluation_grid(scores, candidates, gold(spark, sf_dir), "candidate", "doc"), "mean_f1")


_SHAPES = """
SELECT l_orderkey AS doc, l_discount * 8 AS x0, l_tax * 8 AS y0, CASE WHEN l_discount * 8 + 0.3 > 1 THEN 1 ELSE l_discount * 8 + 0.3 END AS x1, CASE WHEN l_tax * 8 + 0.25 > 1 THEN 1 ELSE l_tax * 8 + 0.25 END AS y1,
  l_partkey % 1000 + 100 AS width, l_suppkey % 700 + 100 AS height
FROM {{lineitem}}
"""


def q67_grown_boxes(spark, sf_dir):
    rows = fixture(spark, sf_dir, _SHAPES)
    box = F.array(*[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")])
    grown = rows.select("doc", "width", "height", geo.grown_pixels(box, F.col("width"), F.col("height"), 0.05).alias("g"))
    shares = geo.to_shares(F.col("g.box"), F.col("width"), F.col("height"))
    sums = [F.sum(F.col("g.box")[i]).alias(c) for i, c in enumerate(("left", "top", "right", "bottom"))]
    return grown.groupBy("doc").agg(*sums, F.count_if("g.clipped").alias("clipped"), F.round(F.sum(shares[2] - shares[0]), 10).alias("share"))


_SEVERAL = "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN concat(' Fig   ', CAST(p_size AS VARCHAR(5))) ELSE ' ' END AS figure, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS label, concat('visual ', CAST(p_partkey AS VARCHAR(9))) AS own FROM {{part}}"


def q68_figure_label(spark, sf_dir):
    return fixture(spark, sf_dir, _SEVERAL).select("id", ops.figure_label(F.col("figure"), F.col("label"), fallback=F.col("own")).alias("figure"))


QUERIES = {f.__name__: f for f in (
    q55_document_inputs, q56_analysis_inputs, q57_batch_counters, q58_split_findings, q58b_merged_findings, q59_scalar_text, q60_figure_slug, q61_crop_composites, q62_part_numbers,
    q63_result_index, q64_insertions, q64b_insertion_summary, q65_joined_chunks, q66_evaluation_grid, q67_grown_boxes, q68_figure_label,
)}
_FINDINGS = f"""
WITH s AS (SELECT DISTINCT * FROM ({plain(_SPLITS)})), k AS (SELECT DISTINCT doc_id FROM labels), o AS (SELECT *, CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 WHEN 'test' THEN 2 END AS place FROM s),
z AS (SELECT count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val FROM s), f AS (
  SELECT 'error' AS severity, 'not_in_gold' AS rule, split AS subject, count(*) AS n FROM s WHERE doc_id NOT IN (SELECT doc_id FROM k) GROUP BY split
  UNION ALL SELECT 'error', 'overlap', split, count(*) FROM o WHERE place > (SELECT min(place) FROM o p WHERE p.doc_id = o.doc_id) GROUP BY split
  UNION ALL SELECT 'error', 'empty_split', 'train', train FROM z WHERE train = 0 UNION ALL SELECT 'error', 'empty_split', 'val', val FROM z WHERE val = 0
  UNION ALL SELECT 'warning', 'small_split', 'val', val FROM z WHERE val BETWEEN 1 AND 2
  UNION ALL SELECT 'warning', 'unused_gold', 'gold', count(*) FROM k WHERE doc_id NOT IN (SELECT doc_id FROM s) HAVING count(*) > 0
)
"""
_INPUTS = f"WITH w AS (SELECT DISTINCT doc_id FROM ({plain(_WANTED)})), t AS ({plain(_TEXTS)}), r AS (SELECT doc_id, count(*) AS records FROM ({plain(_RECORDS)}) GROUP BY doc_id)"
_NAMED = f"""
WITH j AS (SELECT r.doc, r.pos, r.target_id, r.status, r.tables, list_distinct(list_filter([trim(regexp_replace(lower(coalesce(x, '')), '\\s+', ' ', 'g')) FOR x IN [r.visual_ref, r.figure, t.visual_ref, t.figure]], lambda x: x <> '')) AS names
  FROM ({plain(_RESULTS)}) r LEFT JOIN ({plain(_TARGETS)}) t ON t.doc = r.doc AND t.target_id = r.target_id),
i AS (SELECT doc, pos, target_id, status, tables, unnest(names) AS ref FROM j UNION ALL SELECT doc, pos, target_id, status, tables, NULL FROM j WHERE len(names) = 0),
c AS (SELECT doc, ref, arg_min({{'t': target_id, 's': status, 'n': tables}}, pos) AS r, count(*) AS results FROM i WHERE ref IS NOT NULL GROUP BY doc, ref), a AS ({plain(_PLACES)}),
e AS (SELECT a.doc, a.ref, c.r.t AS target_id, CASE WHEN c.r IS NULL THEN 'missing_extraction_result' WHEN c.r.s NOT IN ('success', 'partial') THEN c.r.s WHEN c.r.n = 0 THEN 'no_tables' ELSE 'inserted' END AS reason, coalesce(c.results, 0) AS results
  FROM a LEFT JOIN c ON c.doc = a.doc AND c.ref = a.ref
  UNION ALL SELECT i.doc, i.ref, i.target_id, 'missing_anchor', 1 FROM i WHERE i.ref IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a WHERE a.doc = i.doc AND a.ref = i.ref))
"""
_TRIED_EACH = " UNION ALL ".join(
    f"SELECT coalesce(p.candidate, g.candidate) AS candidate, coalesce(p.doc, g.doc) AS doc, p.{f} IS NOT NULL AS has_p, g.{f} IS NOT NULL AS has_g, coalesce({_hit(f)}, false) AS hit FROM p FULL JOIN g ON p.candidate = g.candidate AND p.doc = g.doc AND p.pos = g.pos"
    for f in FIELDS
)
_PX = "round_even({0} * {1}, 0) {2} round_even({1} * 0.05, 0)"
ORACLES = {
    "q55_document_inputs": _INPUTS + """SELECT CASE WHEN t.doc_id IS NULL THEN 'missing_document' WHEN coalesce(length(trim(t.text)), 0) = 0 THEN 'blank_document' WHEN r.records IS NULL THEN 'missing_gold' ELSE 'kept' END AS outcome, count(*) AS n
FROM w LEFT JOIN t USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY 1""",
    "q56_analysis_inputs": _INPUTS + "SELECT doc_id, coalesce(records, 0) AS records FROM w JOIN t USING (doc_id) LEFT JOIN r USING (doc_id)",
    "q57_batch_counters": f"""WITH c AS ({plain(_CALLS)}), o AS (SELECT *, CASE WHEN pos >= min(CASE WHEN status = 'open' THEN pos END) OVER (PARTITION BY batch) THEN 'stopped' ELSE status END AS outcome FROM c)
SELECT batch, count(*) FILTER (outcome = 'success') AS success, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'stopped') AS stopped, count(*) AS total FROM o GROUP BY batch""",
    "q58_split_findings": _FINDINGS + "SELECT * FROM f",
    "q58b_merged_findings": _FINDINGS + "SELECT count(*) FILTER (severity = 'error') = 0 AS success, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM (SELECT * FROM f UNION ALL SELECT * FROM f WHERE rule = 'unused_gold')",
    "q59_scalar_text": f"SELECT raw, CASE WHEN raw = 'null' THEN NULL WHEN raw = '-0.0' THEN '0' WHEN raw LIKE '-%E-%' THEN replace(raw, 'E-', CASE WHEN raw LIKE '%E-__' THEN 'e-' ELSE 'e-0' END) WHEN raw SIMILAR TO '[0-9]+e[0-9]+' THEN CAST(CAST(CAST(raw AS DOUBLE) AS BIGINT) AS VARCHAR) WHEN raw[1] = '\"' THEN raw[2:-2] WHEN raw LIKE '%.0' THEN raw[:-3] ELSE raw END AS text, count(*) AS n FROM ({plain(_SCALARS)}) GROUP BY 1, 2",
    "q60_figure_slug": f"""WITH n AS (SELECT p_partkey AS id, p_partkey % 4 AS kind, p_partkey % 4 = 2 OR p_partkey % 3 = 1 AS keeps, lower((CASE WHEN p_partkey % 5 = 0 THEN 's' ELSE '' END) || p_size) AS number, p_partkey % 6 AS tail FROM part)
SELECT id, CASE WHEN kind < 2 THEN 'supp_fig_' WHEN kind = 2 THEN 'extended_data_fig_' ELSE 'fig_' END || number || CASE WHEN keeps THEN CASE tail WHEN 0 THEN '_b' WHEN 1 THEN '_c' WHEN 2 THEN 'a' WHEN 4 THEN '_d' ELSE '' END ELSE '' END || CASE WHEN tail = 4 THEN '_and' ELSE '' END AS slug FROM n""",
    "q61_crop_composites": f"SELECT target, count(*) AS parts, max(width) AS width, CAST(sum(height) + 40 * (count(*) - 1) AS BIGINT) AS height, round(sum(share), 6) AS share FROM ({plain(_PARTS)}) GROUP BY target",
    "q62_part_numbers": f"SELECT 'part_' || lpad(CAST(pos AS VARCHAR), 4, '0') AS part, count(*) AS n, CAST(sum(width) AS BIGINT) AS width FROM ({plain(_PARTS)}) GROUP BY 1",
    "q63_result_index": _NAMED + "SELECT * FROM i",
    "q64_insertions": _NAMED + "SELECT * FROM e",
    "q64b_insertion_summary": _NAMED + """SELECT doc, count(*) FILTER (reason = 'inserted') AS inserted, count(*) FILTER (reason IN ('no_tables', 'failed', 'crop_failed', 'no_extractable_chart')) AS without_tables, count(*) FILTER (reason = 'missing_anchor') AS missing_anchors,
  count(*) FILTER (reason = 'missing_extraction_result') AS missing_results, count(*) FILTER (results > 1) AS several_results FROM e GROUP BY doc""",
    "q65_joined_chunks": """WITH u AS (SELECT *, min(CASE WHEN turn = conv_id % 5 + 1 THEN turn END) OVER (PARTITION BY conv_id) AS last_ FROM conversations)
SELECT conv_id, md5(string_agg(coalesce(text, ''), '' ORDER BY turn, text)) AS text_md5, count(*) AS chunks FROM u WHERE last_ IS NULL OR turn <= last_ GROUP BY conv_id""",
    "q66_evaluation_grid": f"""WITH p AS ({plain(_TRIED)}), k AS (SELECT DISTINCT candidate FROM p), t AS ({plain(GOLD)}), g AS (SELECT t.*, k.candidate FROM t CROSS JOIN k), e AS ({_TRIED_EACH}),
f AS (SELECT candidate, doc, coalesce(2 * sum(hit::INT) / nullif(2 * sum(hit::INT) + sum((has_p AND NOT hit)::INT) + sum((has_g AND NOT hit)::INT), 0), 0) AS f1 FROM e GROUP BY candidate, doc),
m AS (SELECT candidate, (SELECT count(DISTINCT doc) FROM t) AS documents, sum(f1) / (SELECT count(DISTINCT doc) FROM t) AS mean_f1 FROM f GROUP BY candidate)
SELECT candidate, documents, round(mean_f1, 6) AS mean_f1, candidate = (SELECT candidate FROM m ORDER BY round(mean_f1, 9) DESC, candidate LIMIT 1) AS chosen FROM m""",
    "q67_grown_boxes": f"""WITH b AS (SELECT doc, width, height, {_PX.format('CAST(x0 AS DOUBLE)', 'width', '-')} AS x0, {_PX.format('CAST(y0 AS DOUBLE)', 'height', '-')} AS y0, {_PX.format('CAST(x1 AS DOUBLE)', 'width', '+')} AS x1, {_PX.format('CAST(y1 AS DOUBLE)', 'height', '+')} AS y1 FROM ({plain(_SHAPES)}))
SELECT doc, CAST(sum(greatest(x0, 0)) AS BIGINT) AS "left", CAST(sum(greatest(y0, 0)) AS BIGINT) AS top, CAST(sum(least(x1, width)) AS BIGINT) AS "right", CAST(sum(least(y1, height)) AS BIGINT) AS bottom,
  count(*) FILTER (x0 < 0 OR y0 < 0 OR x1 > width OR y1 > height) AS clipped, round(sum(least(x1, width) / width - greatest(x0, 0) / width), 10) AS share FROM b GROUP BY doc""",
    "q68_figure_label": f"SELECT id, coalesce(nullif(lower(trim(regexp_replace(figure, '\\s+', ' ', 'g'))), ''), nullif(lower(trim(regexp_replace(label, '\\s+', ' ', 'g'))), ''), own) AS figure FROM ({plain(_SEVERAL)})",
}
