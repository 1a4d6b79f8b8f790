"""Query of the benchmark decontamination; held to brute-force edit distances in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontamination import contaminated


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_benchmark_decontamination": op3_benchmark_decontamination}
ORACLES: dict[str, str] = {}
