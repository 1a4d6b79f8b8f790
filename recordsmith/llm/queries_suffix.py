"""Query of the suffix-array dedup; strings by position are compared with brute force in the tests, not in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .suffix_dedup import remove_repeats


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("text_hash", "kept_text")


QUERIES = {"op5_suffix_array_dedup": op5_suffix_array_dedup}
ORACLES: dict[str, str] = {}
