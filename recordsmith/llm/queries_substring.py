"""Query of the substring dedup; held to brute force in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .substring_dedup import repeated_passages


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
ORACLES: dict[str, str] = {}
