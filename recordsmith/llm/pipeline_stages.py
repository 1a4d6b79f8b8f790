"""The pipeline's stages as functions of documents: each keeps the columns of its input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import toxicity
from .bpe import encode
from .common import table
from .decontamination import clean
from .jaccard_join import near_duplicates
from .queries_bpe import vocabulary
from .suffix_dedup import remove_repeats

#: Near duplicates of the pipeline: five words and four fifths.
WORDS, PERCENT = 5, 80


def _private(name: str) -> str:
    """A column name that no table of a user has."""
    return f"{name}_{uuid.uuid4().hex}"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model, fitted on the corpus's labels, rejects go.

    Null and empty texts score by the model's bias; repeated rows go or stay together; without labels of both classes
    every row stays.
    """
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one of least doc_id stays.

    Rows without doc_id stay, and so do null and empty texts, which link with nothing.  Of rows that repeat a doc_id the one
    of least text stays, and of equal texts the one that the other columns put first.
    """
    groups = near_duplicates(docs, WORDS, PERCENT)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    own, place = [F.col(f"`{c}`") for c in docs.columns], _private("place")
    kept = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").select(*own)
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        others = [c for c, name in zip(own, docs.columns) if name not in ("doc_id", "text")]
        order = Window.partitionBy("doc_id").orderBy("text", *([F.to_json(F.struct(*others))] if others else []))  # maps have no order of their own
        kept = kept.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*own)
    return kept.unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that stand earlier (whole characters only); n_chars is counted anew.

    Rows without doc_id, null texts, and texts that lose nothing are as they were.  Different texts under one doc_id each
    lose their own bytes.
    """
    digest, kept = _private("digest"), _private("kept")
    cut_texts = remove_repeats(docs, as_text=True).where("n_removed > 0").select("doc_id", F.col("text_hash").alias(digest), F.col("kept_text").alias(kept)).dropDuplicates(["doc_id", digest])
    joined = docs.withColumn(digest, F.xxhash64(F.coalesce("text", F.lit("")))).join(cut_texts, ["doc_id", digest], "left")
    new = {"text": F.coalesce(kept, "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(kept).isNotNull(), F.length(kept).cast("long")).otherwise(F.col("n_chars"))
    return joined.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a passage near a benchmark item go.  Null and empty texts stay; repeated rows go or stay together."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each row; null and empty texts have no tokens."""
    return encode(docs, *vocabulary(), full=True).drop("decoded")
