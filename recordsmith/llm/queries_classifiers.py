"""Queries of the two classifiers; SQL cannot express them, the tests hold them to held-out accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import quality, toxicity
from .common import table


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op7_quality_classifier": op7_quality_classifier, "op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
