"""Query of the nearest neighbours; held to brute force in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .nearest import nearest


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op6_nearest_neighbours": op6_nearest_neighbours}
ORACLES: dict[str, str] = {}
