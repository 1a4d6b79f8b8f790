"""Catalogue of runs (agents): latest, best, compared, numbered; schema migration of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import ranked


def listed(runs: DataFrame, task: str | None = None, by: str = "created", limit: int = 0) -> DataFrame:
    """Newest first, or by name; limit 0 is none."""
    rows = runs if task is None else runs.where(F.col("task") == task)
    rows = rows.orderBy(F.desc("created"), "name") if by == "created" else rows.orderBy("name")
    return rows.limit(limit) if limit else rows


def latest(runs: DataFrame) -> DataFrame:
    """The newest run of each task; of equals the first by name."""
    w = Window.partitionBy("task").orderBy(F.desc("created"), "name")
    return runs.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def best(runs: DataFrame, metric: str = "f1") -> DataFrame:
    """The run with the highest metric of each task, of equals the newest; runs without the metric do not count."""
    w = Window.partitionBy("task").orderBy(F.desc(metric), F.desc("created"), "name")
    return runs.where(F.col(metric).isNotNull()).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def compared(runs: DataFrame, metric: str = "f1") -> DataFrame:
    """With ``place`` within each task: by the metric (missing: 0), stable in ``pos``, if the task's first run has the
    metric; else by ``pos``."""
    first = runs.groupBy("task").agg(F.min_by(F.struct(F.col(metric).alias("m")), "pos")["m"].isNotNull().alias("_by_metric"))
    known = runs.join(first, "task").withColumn("_metric", F.when(F.col("_by_metric"), F.coalesce(metric, F.lit(0.0))))
    return ranked(known, ["task"], [F.desc("_metric"), F.col("pos")], "place").drop("_by_metric", "_metric")


def versioned(runs: DataFrame) -> DataFrame:
    """With the run's version within its task, from 1 in the order of creation."""
    return ranked(runs, ["task"], [F.col("created"), F.col("name")], "version")


def migrated(rows: DataFrame, names: Mapping[str, str], wanted: Sequence[str]) -> DataFrame:
    """Columns renamed, missing ones null, others dropped, in the wanted order."""
    renamed = rows.withColumnsRenamed(dict(names))
    return renamed.select(*[F.col(c) if c in renamed.columns else F.lit(None).cast("string").alias(c) for c in wanted])


def fits_format(columns: Sequence[str], wanted: Sequence[str]) -> bool:
    """All wanted columns, or more than half of them."""
    both = len(set(columns) & set(wanted))
    return bool(wanted) and (both == len(set(wanted)) or both / len(set(wanted)) > 0.5)
