"""Writers: documents, reports, stage artefacts and the catalogue of runs.  Folders are whatever Spark can write to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import ranked
from ..operators.states import clean_history


def write_markdown(docs: DataFrame, folder: str) -> None:
    """(key, text): a text file below key=... for each key; keys are dealt over tasks."""
    docs.select("key", F.coalesce("text", F.lit("")).alias("text")).repartition("key").write.partitionBy("key").mode("overwrite").text(folder)


def write_artefact(rows: DataFrame, folder: str, errors: list[str] = (), warnings: list[str] = ()) -> None:
    """Rows as JSON, and beside them one record (status, errors, warnings) that says whether they hold."""
    rows.write.mode("overwrite").json(f"{folder}/data")
    record = rows.sparkSession.createDataFrame([("failed" if errors else "ok", list(errors), list(warnings))], "status string, errors array<string>, warnings array<string>")
    record.coalesce(1).write.mode("overwrite").json(f"{folder}/validation")


def write_report(rows: DataFrame, summary: DataFrame, folder: str, order: list[str]) -> None:
    """A report as CSV with headers, its summary as JSON, and its lines as a Markdown table in parts, by range of the order."""
    rows.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in rows.columns]), F.lit(" |"))
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(line.alias("line")).write.mode("overwrite").text(f"{folder}/markdown")


def saved_run(catalogue: DataFrame, new: DataFrame) -> DataFrame:
    """The catalogue with new runs of a task, whose version goes on from how many the task has."""
    known = catalogue.groupBy("task").agg(F.count(F.lit(1)).alias("_known"))
    numbered = ranked(new, ["task"], [F.col("created"), F.col("name")], "_n").join(known, "task", "left")
    version = (F.coalesce("_known", F.lit(0)) + F.col("_n")).cast("int")
    return catalogue.unionByName(numbered.withColumn("version", version).select(*catalogue.columns))


def without_runs(catalogue: DataFrame, gone: DataFrame) -> DataFrame:
    """The catalogue without the named runs (task, name)."""
    return catalogue.join(gone.select("task", "name"), ["task", "name"], "left_anti").select(*catalogue.columns)


def write_whole(rows: DataFrame, path: str, form: str = "json") -> None:
    """Rows as a folder that is either the old one or the whole new one: written beside it, then put in its place."""
    spark, new = rows.sparkSession, f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path
    store, old = at(path).getFileSystem(context._jsc.hadoopConfiguration()), at(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    try:
        rows.write.format(form).save(new)
    except Exception:
        store.delete(at(new), True)
        raise
    had = store.exists(at(path))
    if had:
        store.rename(at(path), old)
    if not store.rename(at(new), at(path)):
        raise OSError(f"{path} was written by another")
    if had:
        store.delete(old, True)


def write_history(entries: DataFrame, by: str, path: str, text: str = "entry") -> int:
    """Cleaned entries, one JSON object a line, in the order of ``by`` within files; how many."""
    clean = clean_history(entries, by, text).where(F.col(text).isNotNull())
    write_whole(clean.select(by, F.to_json(text).alias("value")).sortWithinPartitions(by).select("value"), path, "text")
    return rows_of(entries.sparkSession, path).count()


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


#: What an analysis holds: rules of entities and of fields, and what documents disagree on.
_ANALYSIS = "kind string, task string, documents long, at string, row string"


def write_analysis(rules: DataFrame, discrepancies: DataFrame, path: str, task: str, documents: int, at: str) -> None:
    """An analysis as JSON lines, read again by read_analysis()."""
    part = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.lit(task).alias("task"), F.lit(documents).cast("long").alias("documents"), F.lit(at).alias("at"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
    write_whole(part(rules, "rule").unionByName(part(discrepancies, "discrepancy")), path)


def read_analysis(spark: SparkSession, path: str, rules: str, discrepancies: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(task, documents, at), rules and discrepancies of the schemas given."""
    rows = spark.read.schema(_ANALYSIS).json(path)
    part = lambda kind, schema: rows.where(F.col("kind") == kind).select(F.from_json("row", schema).alias("r")).select("r.*")
    return rows.select("task", "documents", "at").distinct(), part("rule", rules), part("discrepancy", discrepancies)


def rules_of(rules: DataFrame, level: str | None = None, field: str | None = None) -> DataFrame:
    """Rules of a level (entity, field) or of one field."""
    rows = rules if level is None else rules.where(F.col("level") == level)
    return rows if field is None else rows.where(F.col("field_name") == field)
