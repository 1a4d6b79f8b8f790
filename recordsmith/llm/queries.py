"""All queries of this package and their SQL."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict = {}
for _name in (
    "queries_lm", "queries_jaccard", "queries_decontamination", "queries_bpe", "queries_suffix",
    "queries_nearest", "queries_classifiers", "queries_fixity", "queries_substring",
    "queries_topk", "queries_collocations", "queries_alignment",
):
    _module = import_module(f".{_name}", __package__)
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES


def pipeline(spark, sf_dir):
    """The stages of corpus_pipeline.py, one after the other."""
    return import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
