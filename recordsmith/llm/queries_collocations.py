"""Query of the collocations and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .collocations import collocations
from .common import table


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op13_phrase_collocations": op13_phrase_collocations}
ORACLES = {
    "op13_phrase_collocations": r"""
        WITH d AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
        total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
        g AS (
            SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase
            FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k)
        ), f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, count(*)::BIGINT AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
        c AS (SELECT lang, k, phrase, ws, f AS a FROM f WHERE k >= 2),
        parts AS (
            SELECT lang, a, array_to_string(ws[i : i + m - 1], ' ') AS phrase
            FROM (SELECT lang, a, k, ws, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest(range(2, 5)) AS m) WHERE m < k)
        ), inside AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN parts p ON p.lang = c.lang AND p.phrase = c.phrase AND 100 * p.a >= 100 * c.a),
        cuts AS (
            SELECT s.*, l.f AS l, r.f AS r, total.n, ((1000::HUGEINT * s.a * total.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
            FROM (SELECT c.*, unnest(range(1, k)) AS j FROM c ANTI JOIN inside ON c.lang = inside.lang AND c.phrase = inside.phrase) s
            JOIN f l ON l.lang = s.lang AND l.k = s.j AND l.phrase = array_to_string(s.ws[1 : s.j], ' ')
            JOIN f r ON r.lang = s.lang AND r.k = s.k - s.j AND r.phrase = array_to_string(s.ws[s.j + 1 : s.k], ' ')
            JOIN total ON total.lang = s.lang
        ), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM best QUALIFY rank <= 2000
    """
}
