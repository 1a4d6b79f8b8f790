"""Query and SQL of the fixity audit.

The replica is a copy of the records with planted damage: by the first hex digit of the number's md5, one record in
sixteen has its last sign of payload overwritten and one in sixteen is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .fixity import FILE_RECORDS, audit, record


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    draw = F.substring(F.md5(F.col("page_id").cast("string")), 1, 1)
    whole = F.coalesce("html", F.lit(""))
    damaged = F.when(draw == "0", F.concat(F.substring(whole, F.lit(1), F.greatest(F.length(whole) - 1, F.lit(0))), F.lit("\u007f"))).otherwise(whole)
    replica = pages.where(F.coalesce(draw != "1", F.lit(True))).select("page_id", record(F.col("url"), damaged).alias("record"))
    return audit(pages.select("page_id", record(F.col("url"), F.col("html")).alias("record")), replica)


SQL = f"""
WITH whole AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, substr(md5(CAST(page_id AS VARCHAR)), 1, 1) AS draw
  FROM pages WHERE page_id IS NOT NULL
), both_ AS (
  SELECT *, CASE WHEN draw = '0' THEN substr(html, 1, greatest(length(html) - 1, 0)) || chr(127) ELSE html END AS other FROM whole
), made AS (
  SELECT page_id, draw,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
      || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS mine,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
      || 'Content-Length: ' || strlen(other) || chr(13) || chr(10) || chr(13) || chr(10) || other || chr(13) || chr(10) || chr(13) || chr(10) AS theirs
  FROM both_
), placed AS (
  SELECT *, CAST(page_id // {FILE_RECORDS} AS BIGINT) AS file_id,
    CAST(sum(strlen(mine)) OVER (PARTITION BY page_id // {FILE_RECORDS} ORDER BY page_id) AS BIGINT) AS end_offset
  FROM made
)
SELECT file_id, page_id, CASE WHEN draw = '1' THEN 'lost' ELSE 'changed' END AS status,
  CAST(end_offset - strlen(mine) AS BIGINT) AS start_offset, end_offset, sha256(mine) AS expected_sha256,
  CASE WHEN draw <> '1' THEN sha256(theirs) END AS found_sha256
FROM placed WHERE draw = '1' OR mine <> theirs
"""

QUERIES = {"op8_warc_fixity": op8_warc_fixity}
ORACLES = {"op8_warc_fixity": SQL}
