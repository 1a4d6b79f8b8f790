"""Tables, and fixtures that are written once as SQL for both engines."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_checkpoints


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs SQL that both engines read, over the tables it names in double braces."""
    names = set(re.findall(r"\{\{(\w+)\}\}", sql))
    escaped = "".join(f"{{{part}}}" if i % 2 else part.replace("{", "{{").replace("}", "}}") for i, part in enumerate(re.split(r"\{\{(\w+)\}\}", sql)))
    return spark.sql(escaped, **{n: table(spark, sf_dir, n) for n in names})


def plain(sql: str) -> str:
    """The same SQL for the oracle, where tables are views."""
    return re.sub(r"\{\{(\w+)\}\}", r"\1", sql)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{shared_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"
