"""Query of byte-level BPE; compared with the public library and by round trip in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bpe import encode
from .common import table

def vocabulary() -> tuple[str, str]:
    """Path of the ranks and the splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op4_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), *vocabulary())


QUERIES = {"op4_byte_level_bpe": op4_byte_level_bpe}
ORACLES: dict[str, str] = {}
