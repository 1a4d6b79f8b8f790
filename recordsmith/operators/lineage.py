"""Cutting lineage between the rounds of an iterated job."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_checkpoints(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, by spark.checkpoint.dir; where none is named, a temporary one in a local session and an error on a cluster."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return context._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """Computed once and kept in the shared folder."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint()
