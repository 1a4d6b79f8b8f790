"""Query and SQL of LM scoring: how like three chosen sources each document is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .lm_scoring import BIGRAM_PRIOR, UNIGRAM_PRIOR, score

TARGET_SOURCES = ("src1", "src2", "src3")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), F.col("source").isin(*TARGET_SOURCES))
    return scored.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("ce_target", "ce_background", "score")])


SQL = rf"""
WITH low AS (
  SELECT doc_id, source IN {TARGET_SOURCES} AS target,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL
), flat AS (
  SELECT doc_id, target, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM low
), seq AS (
  SELECT doc_id, target, i, 'w' || word AS id FROM flat
  UNION ALL SELECT doc_id, target, 0, 'begin' FROM low UNION ALL SELECT doc_id, target, len(w) + 1, 'end' FROM low
), uni AS (
  SELECT id, count(*) AS n, count(*) FILTER (target) AS t FROM seq GROUP BY id
), total AS (
  SELECT sum(n) AS n, sum(t) AS t FROM uni WHERE id <> 'begin'
), size AS (
  SELECT count(*) AS k FROM uni WHERE id <> 'begin'
), pairs AS (
  SELECT doc_id, target, id AS w, lag(id) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM seq
), bi AS (
  SELECT v, w, count(*) AS n, count(*) FILTER (target) AS t FROM pairs WHERE v IS NOT NULL GROUP BY v, w
), loss AS (
  SELECT b.v, b.w,
    -ln((b.t + {BIGRAM_PRIOR} * (w.t + {UNIGRAM_PRIOR}) / (total.t + {UNIGRAM_PRIOR} * k)) / (v.t + {BIGRAM_PRIOR})) AS lt,
    -ln((b.n + {BIGRAM_PRIOR} * (w.n + {UNIGRAM_PRIOR}) / (total.n + {UNIGRAM_PRIOR} * k)) / (v.n + {BIGRAM_PRIOR})) AS lb
  FROM bi b JOIN uni v ON v.id = b.v JOIN uni w ON w.id = b.w CROSS JOIN total CROSS JOIN size
)
SELECT p.doc_id, count(*) AS n_tokens, round(sum(lt) / count(*), 6) AS ce_target, round(sum(lb) / count(*), 6) AS ce_background,
  round((sum(lt) - sum(lb)) / count(*), 6) AS score
FROM pairs p JOIN loss l ON l.v = p.v AND l.w = p.w GROUP BY p.doc_id
"""

QUERIES = {"op1_lm_scoring": op1_lm_scoring}
ORACLES = {"op1_lm_scoring": SQL}
