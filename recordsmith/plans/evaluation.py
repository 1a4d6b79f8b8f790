"""Queries of scoring.  A document is an order, a record a line; the found records are a damaged copy of the gold ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import document_key, extraction_key, is_close, normal_text, split_key, stem_key, value_match
from ..operators import scoring
from .base import fixture, plain, rounded, table

GOLD = """
SELECT doc, pos, flag, status, quantity, discount, shipped FROM (
  SELECT l_orderkey AS doc, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS pos,
    l_returnflag AS flag, CASE WHEN l_partkey % 9 <> 0 THEN l_linestatus END AS status, l_quantity AS quantity, l_discount AS discount, CAST(CAST(l_shipdate AS DATE) AS VARCHAR(10)) AS shipped
  FROM {{lineitem}}) x
"""
FOUND = f"""
SELECT doc, pos, CASE WHEN (doc + pos) % 7 <> 0 THEN flag END AS flag, CASE WHEN (doc + pos) % 6 = 0 THEN 'X' ELSE status END AS status,
  CASE WHEN (doc + pos) % 5 = 0 THEN quantity + 1 ELSE quantity END AS quantity, discount, CASE WHEN doc % 4 = 0 THEN concat(shipped, ' ') ELSE shipped END AS shipped
FROM ({GOLD}) g WHERE (doc + pos) % 11 <> 0
UNION ALL
SELECT doc, pos + 1000 AS pos, flag, status, quantity, discount, shipped FROM ({GOLD}) h WHERE (doc + pos) % 13 = 0
"""
FIELDS = {"flag": False, "status": False, "quantity": True, "discount": True, "shipped": False}


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, GOLD)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, FOUND)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.pair_outcomes(found(spark, sf_dir), gold(spark, sf_dir), ["doc", "pos"], FIELDS)


def _hit(f: str, a: str = "p", b: str = "g") -> str:
    if FIELDS[f]:
        return f"({a}.{f} = {b}.{f} OR abs({a}.{f} - {b}.{f}) <= 1e-9 * greatest(abs({a}.{f}), abs({b}.{f})))"
    return f"(regexp_replace({a}.{f}, '\\s+', '', 'g') = regexp_replace({b}.{f}, '\\s+', '', 'g'))"


_EACH = " UNION ALL ".join(
    f"SELECT coalesce(p.doc, g.doc) AS doc, '{f}' AS field, p.{f} IS NOT NULL AS has_p, g.{f} IS NOT NULL AS has_g, coalesce({_hit(f)}, false) AS hit FROM p FULL JOIN g ON p.doc = g.doc AND p.pos = g.pos"
    for f in FIELDS
)
_COMPARED = " UNION ALL ".join(
    f"SELECT coalesce(p.doc, g.doc) AS doc, '{f}' AS field, CAST(p.{f} AS VARCHAR) AS a, CAST(g.{f} AS VARCHAR) AS b, coalesce({_hit(f)}, false) AS hit FROM p FULL JOIN g ON p.doc = g.doc AND p.pos = g.pos" for f in FIELDS
)
OUTCOMES = f"""
WITH g AS ({plain(GOLD)}), p AS ({plain(FOUND)}), e AS ({_EACH}), o AS (
  SELECT doc, field, hit::INT AS tp, (has_p AND NOT hit)::INT AS fp, (has_g AND NOT hit)::INT AS fn, (has_p OR has_g)::INT AS total FROM e
)
"""
_PRF = """
CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
round(coalesce(sum(tp) / nullif(sum(tp) + sum(fp), 0), 0), 6) AS precision, round(coalesce(sum(tp) / nullif(sum(tp) + sum(fn), 0), 0), 6) AS recall,
round(coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0), 6) AS f1
"""


def q01_field_confusion(spark, sf_dir):
    return outcomes(spark, sf_dir).groupBy("field").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "total", "correct")])


def q02_micro_prf(spark, sf_dir):
    return rounded(scoring.precision_recall(outcomes(spark, sf_dir)), "precision", "recall", "f1")


def q03_doc_f1(spark, sf_dir):
    return rounded(scoring.precision_recall(outcomes(spark, sf_dir), ["doc"]), "precision", "recall", "f1")


def q04_macro_f1(spark, sf_dir):
    scores = scoring.precision_recall(outcomes(spark, sf_dir), ["doc"])
    return rounded(scoring.macro_f1(scores, table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "doc"), "doc"), "mean_f1")


def q05_field_accuracy(spark, sf_dir):
    return rounded(scoring.field_accuracy(outcomes(spark, sf_dir), [*FIELDS, "never_seen"]), "accuracy")


def q06_similarity_pairs(spark, sf_dir):
    pairs = scoring.similarities(found(spark, sf_dir), gold(spark, sf_dir), "doc", "pos", FIELDS)
    return pairs.groupBy("doc", "found_pos").agg(F.count(F.lit(1)).alias("gold_records"), F.sum("matches").alias("matches"), F.max("matches").alias("best"))


def q07_alignment_total(spark, sf_dir):
    pairs = scoring.align(found(spark, sf_dir), gold(spark, sf_dir), "doc", "pos", FIELDS)
    return pairs.groupBy("doc").agg(F.count("matches").alias("pairs"), F.coalesce(F.sum("matches"), F.lit(0)).alias("total"), F.count_if(F.col("gold_pos").isNull()).alias("found_alone"), F.count_if(F.col("found_pos").isNull()).alias("gold_alone"))


def q08_alignment_scores(spark, sf_dir):
    return rounded(scoring.precision_recall(scoring.aligned_outcomes(found(spark, sf_dir), gold(spark, sf_dir), "doc", "pos", FIELDS), ["doc"]), "precision", "recall", "f1")


def q08b_document_metric(spark, sf_dir):
    """The same F1 of JSON texts; every seventeenth document's found text is cut, and counts as holding nothing."""
    text = lambda df, name: df.groupBy("doc").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("pos", *FIELDS))), lambda r: F.struct(*[r[f].alias(f) for f in FIELDS])).alias("experiments"))).alias(name))
    rows = text(gold(spark, sf_dir), "gold").join(text(found(spark, sf_dir), "found"), "doc", "left")
    rows = rows.withColumn("found", F.when(F.col("doc") % 17 == 0, F.substring("found", 1, 30)).otherwise(F.col("found")))
    return rounded(scoring.document_metric(rows, "doc", "found", "gold", FIELDS), "f1")


def q82_field_comparison(spark, sf_dir):
    """The differences of each pair of records; a judge agrees to every third of them."""
    pairs = scoring.field_comparison(found(spark, sf_dir), gold(spark, sf_dir), ["doc", "pos"], FIELDS)
    verdicts = pairs.where("not strict").select("doc", "pos", "field", F.when(F.col("doc") % 3 == 0, " yes ").when(F.col("doc") % 3 == 1, "no").alias("verdict"))
    judged = scoring.field_comparison(found(spark, sf_dir), gold(spark, sf_dir), ["doc", "pos"], FIELDS, verdicts)
    return judged.groupBy("field", "strict", "judge").agg(F.count(F.lit(1)).alias("n"), F.count("found").alias("n_found"), F.count("gold").alias("n_gold"), F.count_if(F.col("found") == F.col("gold")).alias("same_text"))


_TEXTS = "SELECT doc_id, concat(text, ' – ', lang, ' — ', source, ' − ') AS raw, text FROM {{documents}}"


def q09_normal_text(spark, sf_dir):
    return fixture(spark, sf_dir, _TEXTS).select("doc_id", F.md5(normal_text(F.col("raw"))).alias("normal_md5"), F.length(normal_text(F.col("text"))).cast("long").alias("n"))


_VALUES = """
SELECT l_orderkey AS doc, l_linenumber AS line, l_partkey AS part,
  CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN 'about ten' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) END AS found,
  CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 3 = 0 THEN concat(CAST(CAST(l_quantity AS INT) AS VARCHAR(20)), '.0') ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) END AS gold,
  l_extendedprice AS a, l_extendedprice * (1 + CASE l_partkey % 3 WHEN 0 THEN 1e-10 WHEN 1 THEN 1e-6 ELSE 0 END) AS b
FROM {{lineitem}}
"""


def q10_value_match(spark, sf_dir):
    v = fixture(spark, sf_dir, _VALUES)
    as_number, as_text = value_match(F.col("found"), F.col("gold"), True), value_match(F.col("found"), F.col("gold"), False)
    return v.groupBy((F.col("part") % 105).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(as_number).alias("as_number"), F.count_if(as_text).alias("as_text"))


def q11_is_close(spark, sf_dir):
    return fixture(spark, sf_dir, _VALUES).groupBy((F.col("part") % 3).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_close(F.col("a"), F.col("b"))).alias("close"))


_IDS = """
SELECT doc_id, concat(' ', CASE doc_id % 3 WHEN 0 THEN upper(source) ELSE source END, CAST(doc_id AS VARCHAR(20)),
  CASE doc_id % 8 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.txt' WHEN 3 THEN '_parsed' WHEN 4 THEN '_result' WHEN 5 THEN '_Extraction' WHEN 6 THEN '.JSON' ELSE '_extractions' END) AS raw
FROM {{documents}}
"""


def q12_document_keys(spark, sf_dir):
    raw = F.col("raw")
    return fixture(spark, sf_dir, _IDS).select("doc_id", document_key(raw).alias("document"), stem_key(raw).alias("stem"), extraction_key(raw).alias("extraction"), split_key(raw).alias("split"))


QUERIES = {f.__name__: f for f in (
    q01_field_confusion, q02_micro_prf, q03_doc_f1, q04_macro_f1, q05_field_accuracy, q06_similarity_pairs, q07_alignment_total,
    q08_alignment_scores, q08b_document_metric, q82_field_comparison, q09_normal_text, q10_value_match, q11_is_close, q12_document_keys,
)}
_NULLS = " + ".join(f"(CASE WHEN p.{f} IS NULL THEN g.{f} IS NULL WHEN g.{f} IS NULL THEN false ELSE {_hit(f)} END)::INT" for f in FIELDS)
_VALUES_SAME = " + ".join(f"coalesce({_hit(f)}, false)::INT" for f in FIELDS)
_PRESENT = " + ".join(f"count({f})" for f in FIELDS)
#: Largest gain of each document by dynamic programming over its found records and the sets of gold ones used: matching fields, times 1000, plus those that match by a value.
_BEST = f"""WITH RECURSIVE g AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) - 1 AS i FROM ({plain(GOLD)})), p AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) - 1 AS i FROM ({plain(FOUND)})),
n AS (SELECT coalesce(a.doc, b.doc) AS doc, coalesce(np, 0) AS np, coalesce(ng, 0) AS ng FROM (SELECT doc, count(*) AS np FROM p GROUP BY doc) a FULL JOIN (SELECT doc, count(*) AS ng FROM g GROUP BY doc) b ON a.doc = b.doc),
m AS (SELECT p.doc, p.i, g.i AS j, 1000 * ({_NULLS}) + {_VALUES_SAME} AS matches FROM p JOIN g ON p.doc = g.doc),
best AS (
  SELECT doc, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS total FROM n
  UNION ALL SELECT doc, i, used, max(total) AS total FROM (
    SELECT b.doc, b.i + 1 AS i, b.used, b.total FROM best b JOIN n ON n.doc = b.doc WHERE b.i < n.np
    UNION ALL SELECT b.doc, b.i + 1, b.used | (CAST(1 AS BIGINT) << m.j), b.total + m.matches FROM best b JOIN m ON m.doc = b.doc AND m.i = b.i WHERE (b.used >> m.j) & 1 = 0
  ) GROUP BY doc, i, used
)
"""
ORACLES = {
    "q01_field_confusion": OUTCOMES + "SELECT field, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(total) AS BIGINT) AS total, CAST(sum(tp) AS BIGINT) AS correct FROM o GROUP BY field",
    "q02_micro_prf": OUTCOMES + f"SELECT {_PRF} FROM o",
    "q03_doc_f1": OUTCOMES + f"SELECT doc, {_PRF} FROM o GROUP BY doc",
    "q04_macro_f1": OUTCOMES + """, f AS (SELECT doc, coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0) AS f1 FROM o GROUP BY doc)
SELECT count(*) AS documents, round(avg(coalesce(f1, 0)), 6) AS mean_f1 FROM (SELECT DISTINCT o_orderkey AS doc FROM orders) d LEFT JOIN f USING (doc)""",
    "q05_field_accuracy": OUTCOMES + """, s AS (SELECT field, sum(total) AS total, sum(tp) AS correct FROM o GROUP BY field)
SELECT f.field, CAST(coalesce(total, 0) AS BIGINT) AS total, CAST(coalesce(correct, 0) AS BIGINT) AS correct, round(coalesce(correct / nullif(total, 0), 1), 6) AS accuracy
FROM (SELECT unnest(['flag', 'status', 'quantity', 'discount', 'shipped', 'never_seen']) AS field) f LEFT JOIN s USING (field)""",
    "q06_similarity_pairs": f"""WITH g AS ({plain(GOLD)}), p AS ({plain(FOUND)}), m AS (SELECT p.doc, p.pos AS found_pos, {_NULLS} AS matches FROM p JOIN g ON p.doc = g.doc)
SELECT doc, found_pos, count(*) AS gold_records, CAST(sum(matches) AS BIGINT) AS matches, CAST(max(matches) AS BIGINT) AS best FROM m GROUP BY doc, found_pos""",
    "q07_alignment_total": _BEST + """SELECT doc, least(np, ng) AS pairs, CAST(total // 1000 AS BIGINT) AS total, np - least(np, ng) AS found_alone, ng - least(np, ng) AS gold_alone
FROM (SELECT doc, max(total) AS total FROM best GROUP BY doc) JOIN n USING (doc)""",
    "q08_alignment_scores": _BEST + f""", has_p AS (SELECT doc, {_PRESENT} AS n FROM p GROUP BY doc), has_g AS (SELECT doc, {_PRESENT} AS n FROM g GROUP BY doc),
s AS (SELECT doc, total % 1000 AS tp, coalesce(has_p.n, 0) - total % 1000 AS fp, coalesce(has_g.n, 0) - total % 1000 AS fn
  FROM (SELECT doc, max(total) AS total FROM best GROUP BY doc) LEFT JOIN has_p USING (doc) LEFT JOIN has_g USING (doc))
SELECT doc, {_PRF} FROM s GROUP BY doc""",
    "q08b_document_metric": _BEST + """, tp AS (SELECT doc, CASE WHEN doc % 17 = 0 THEN 0 ELSE max(total) % 1000 END AS tp FROM best GROUP BY doc), has_p AS (SELECT doc, PRESENT AS n FROM p GROUP BY doc), has_g AS (SELECT doc, PRESENT AS n FROM g GROUP BY doc)
SELECT has_g.doc, round(coalesce(2 * tp / nullif(coalesce(has_p.n, 0) + has_g.n, 0), 0), 6) AS f1 FROM has_g LEFT JOIN tp USING (doc) LEFT JOIN has_p USING (doc)""".replace("PRESENT", _PRESENT),
    "q82_field_comparison": f"""WITH g AS ({plain(GOLD)}), p AS ({plain(FOUND)}), e AS ({_COMPARED})
SELECT field, hit AS strict, CASE WHEN NOT hit THEN CASE WHEN doc % 3 = 0 THEN 'YES' ELSE 'NO' END END AS judge, count(*) AS n, count(a) AS n_found, count(b) AS n_gold, count(*) FILTER (a = b) AS same_text FROM e WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY 1, 2, 3""",
    "q09_normal_text": f"SELECT doc_id, md5(regexp_replace(translate(raw, '−–—', '---'), '\\s+', '', 'g')) AS normal_md5, CAST(length(regexp_replace(translate(text, '−–—', '---'), '\\s+', '', 'g')) AS BIGINT) AS n FROM ({plain(_TEXTS)})",
    "q10_value_match": f"""WITH v AS ({plain(_VALUES)}), m AS (SELECT part % 105 AS kind, CASE WHEN gold IS NULL THEN found IS NULL WHEN found IS NULL THEN false ELSE found = gold END AS as_text,
  CASE WHEN gold IS NULL THEN found IS NULL WHEN found IS NULL THEN false WHEN try_cast(found AS DOUBLE) IS NOT NULL THEN try_cast(found AS DOUBLE) = try_cast(gold AS DOUBLE) ELSE found = gold END AS as_number FROM v)
SELECT kind, count(*) AS n, count(*) FILTER (as_number) AS as_number, count(*) FILTER (as_text) AS as_text FROM m GROUP BY kind""",
    "q11_is_close": f"SELECT part % 3 AS kind, count(*) AS n, count(*) FILTER (a = b OR abs(a - b) <= 1e-9 * greatest(abs(a), abs(b))) AS close FROM ({plain(_VALUES)}) GROUP BY 1",
    "q12_document_keys": f"""SELECT doc_id, regexp_replace(lower(trim(raw)), '\\.(pdf|txt|doc)$', '') AS document, regexp_replace(trim(lower(raw)), '(_parsed|_processed|_result)$', '') AS stem,
  trim(lower(regexp_replace(raw, '(_extractions|_extraction|_result|_ext)$', ''))) AS extraction, trim(lower(regexp_replace(raw, '\\.(pdf|PDF|txt|TXT|doc|DOC|json|JSON)$', ''))) AS split FROM ({plain(_IDS)})""",
}
