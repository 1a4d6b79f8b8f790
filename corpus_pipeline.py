"""A training-data pipeline of this library's operators: each stage is written as Parquet and read as the next's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordsmith.llm.common import cut, release, table
from recordsmith.llm.pipeline_stages import cut_repeats, drop_contaminated, one_of_each_group, reject_toxic, tokenise

STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_level_bpe", tokenise),
]

#: A trained model decides in the first stage, which SQL cannot express; the tests hold each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are in the shared checkpoint folder, until the next stage is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        release(before)
        before = docs
    return docs
