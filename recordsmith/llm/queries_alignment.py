"""Query of the alignment of two tokenizers; held to brute force in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .alignment import align
from .common import table


def vocabularies() -> tuple[str, str]:
    """Paths of the byte-level and of the piece vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), *vocabularies())


QUERIES = {"op11_tokenizer_alignment": op11_tokenizer_alignment}
ORACLES: dict[str, str] = {}
