"""Readers and writers of the library's files: documents, ground truth, splits, extractions, runs, artefacts."""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import document_key, extraction_key, stem_key
from ..operators.corpus import Field, Task

#: Endings of a document's file name, first choice first.
DOCUMENT_ENDINGS = ("", "_parsed", "_processed", "_result")
#: Where the records may stand in an extraction file, by the first key that is there.
LAYOUTS = ("extraction", "experiments", "extracted_data")


def _stem(c: str = "_metadata.file_name"):
    return F.regexp_replace(F.col(c), r"\.[^.]*$", "")


def documents(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """(doc_key, file, text) of a folder's files; of files with one key the last by name."""
    rows = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(stem_key(_stem()).alias("doc_key"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    w = Window.partitionBy("doc_key").orderBy(F.desc("file"))
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def document_keys(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """Keys only; no text is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(stem_key(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)).alias("doc_key")).distinct()


def looked_up(files: DataFrame, keys: DataFrame) -> DataFrame:
    """(stem, text) and (doc_key) -> (doc_key, text): the file whose stem is the key with the first of the endings, else
    one that agrees but for case."""
    wanted = keys.select("doc_key", F.posexplode(F.array(*[F.concat("doc_key", F.lit(e)) for e in DOCUMENT_ENDINGS])).alias("place", "stem"))
    exact = wanted.join(files, "stem").select("doc_key", "place", "text")
    loose = wanted.join(files.withColumn("low", F.lower("stem")).drop("stem"), F.lower(F.col("stem")) == F.col("low")).select("doc_key", (F.col("place") + 10).alias("place"), "text")
    return exact.unionByName(loose).groupBy("doc_key").agg(F.min_by("text", "place").alias("text"))


def document(spark: SparkSession, folder: str, key: str, pattern: str = "*.md") -> str:
    """The text of one document; an error if there is none."""
    rows = documents(spark, folder, pattern).where(F.col("doc_key") == stem_key(F.lit(key))).select("text").head(1)
    if not rows:
        raise FileNotFoundError(f"no document {key} in {folder}")
    return rows[0].text


def existing(files: DataFrame, keys: DataFrame) -> DataFrame:
    """(stem) and (doc_key) -> (doc_key, exists): whether some file's stem is the key with one of the endings, case mattering."""
    wanted = keys.select("doc_key").distinct()
    stems = wanted.select("doc_key", F.explode(F.array(*[F.concat("doc_key", F.lit(e)) for e in DOCUMENT_ENDINGS])).alias("stem"))
    have = stems.join(files.select("stem"), "stem", "left_semi").select("doc_key").distinct().withColumn("exists", F.lit(True))
    return wanted.join(have, "doc_key", "left").select("doc_key", F.coalesce("exists", F.lit(False)).alias("exists"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table as texts (no type is guessed), header names in lower case without blanks around."""
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    if not rows.columns:
        raise ValueError(f"no columns in {path}")
    return rows.toDF(*[c.lower().strip() for c in rows.columns])


#: Names of the column that holds the document, first choice first.
ID_COLUMNS = ("pdf", "filename", "source", "doi", "document")


def id_column(columns: Sequence[str]) -> str:
    for name in ID_COLUMNS:
        if name in columns:
            return name
    raise ValueError(f"none of {', '.join(ID_COLUMNS)} is a column")


def splits(spark: SparkSession, path: str, normalise: bool = True) -> DataFrame:
    """(split, doc_key) of a JSON object of arrays."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("split", "ids"))
    key = document_key(F.col("id")) if normalise else F.col("id")
    return rows.select("split", F.explode("ids").alias("id")).select("split", key.alias("doc_key")).distinct()


def split(spark: SparkSession, path: str, name: str, normalise: bool = True) -> DataFrame:
    """(doc_key) of one split; an unknown one has none, and a warning says which there are."""
    every = splits(spark, path, normalise)
    rows = every.where(F.col("split") == name).select("doc_key")
    names = spark.read.text(path, wholetext=True).select(F.explode(F.map_keys(F.from_json("value", "map<string,array<string>>"))).alias("split")).distinct()
    if names.where(F.col("split") == name).isEmpty():
        warnings.warn(f"no split {name} in {path}; there are {', '.join(sorted(r.split for r in names.collect()))}", stacklevel=2)  # a few names
    return rows


def write_splits(rows: DataFrame, path: str) -> None:
    """One JSON object with sorted arrays; a row of arrays holds a split's keys."""
    each = rows.groupBy("split").agg(F.array_sort(F.collect_set("doc_key")).alias("ids"))
    each.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "ids"))))).alias("value")).write.mode("overwrite").text(path)


def extractions(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """(doc_key, pos, record JSON, problem) of a folder's JSON files.

    Records stand in extraction.experiments, experiments, extracted_data.experiments, or are the whole array; the first
    key that is there counts.  A file that cannot be read is a row with a problem, or an error if strict.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text in zip(batch["doc_key"], batch["value"]):
                try:
                    data = json.loads(text)
                    if isinstance(data, dict):
                        first = next(k for k in LAYOUTS if k in data)
                        data = data[first] if first == "experiments" else data[first]["experiments"]
                    out += [(key, i, json.dumps(r, ensure_ascii=False), None) for i, r in enumerate(data)]
                except (ValueError, StopIteration, KeyError, TypeError) as error:
                    if strict:
                        raise ValueError(f"{key}: {error!r}") from error
                    out.append((key, None, None, f"{type(error).__name__}"))
            yield pd.DataFrame(out, columns=["doc_key", "pos", "record", "problem"]).astype({"pos": "Int64"})

    rows = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(extraction_key(_stem()).alias("doc_key"), "value")
    return rows.mapInPandas(run, "doc_key string, pos long, record string, problem string")


def write_extractions(records: DataFrame, path: str) -> None:
    """(doc_key, pos, record struct) -> a JSON line for each document, in folders by key."""
    each = records.groupBy("doc_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "record"))), lambda x: x["record"]).alias("experiments"))
    each.select("doc_key", F.struct("experiments").alias("extraction")).write.mode("overwrite").partitionBy("doc_key").json(path)


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """(name, task, state, meta) of run files and their sidecars; without a sidecar the task is the name's first part."""
    rows = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), "value")
    states = rows.where(~F.col("file").endswith(".meta.json")).select(F.regexp_replace("file", r"\.json$", "").alias("name"), "modified", F.col("value").alias("state"))
    meta = rows.where(F.col("file").endswith(".meta.json")).select(F.regexp_replace("file", r"\.meta\.json$", "").alias("name"), F.col("value").alias("meta"))
    task = F.coalesce(F.get_json_object("meta", "$.task_name"), F.split_part("name", F.lit("_"), F.lit(1)))
    created = F.coalesce(F.get_json_object("meta", "$.created_at"), F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss"))
    return states.join(meta, "name", "left").select("name", task.alias("task"), created.alias("created"), "state", F.from_json(F.get_json_object("meta", "$.metrics"), "map<string,double>").alias("metrics"))


def pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """Paths and sizes of PDF files, at any depth."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{pdf,PDF}").load(folder).select("path", "length")


def artefacts(spark: SparkSession, folder: str, target_id: str | None = None, most: int | None = None) -> DataFrame:
    """JSON artefacts of targets, in the order of their ids."""
    rows = spark.read.option("multiLine", True).json(folder)
    rows = rows if target_id is None else rows.where(F.col("target_id") == target_id)
    rows = rows.orderBy("target_id")
    return rows if most is None else rows.limit(most)


def task_from(declared: dict) -> Task:
    """A task declaration as read from YAML or JSON; an unknown type is text."""
    kinds = {"str": "str", "string": "str", "int": "int", "integer": "int", "float": "float", "number": "float", "bool": "bool", "boolean": "bool"}
    fields = declared.get("fields", {})
    items = fields.items() if isinstance(fields, dict) else [(f["name"], f) for f in fields]
    aliases = declared.get("row_converter", {})
    made = [
        Field(name, kinds.get(str(f.get("type", "str")).lower(), "str"), bool(f.get("required")), tuple(aliases.get(name, (name,))), tuple(f.get("choices") or ()), f.get("min_value"), f.get("max_value"), f.get("pattern"), f.get("default"))
        for name, f in items
    ]
    return Task(declared.get("name", "task"), tuple(made), tuple(declared.get("compare_fields") or ()))


def declaration(task: Task) -> dict:
    """What task_from() reads: a task's declaration with all that its fields must meet."""
    kinds = {"str": "string", "int": "integer", "float": "number", "bool": "boolean"}
    parts = lambda f: {"type": kinds[f.kind], "required": f.required, "choices": list(f.choices), "min_value": f.low, "max_value": f.high, "pattern": f.pattern, "default": f.default}
    fields = {f.name: {k: v for k, v in parts(f).items() if not (v is None or v is False or v == [])} for f in task.fields}
    return {"name": task.name, "fields": fields, "row_converter": {f.name: list(f.columns) for f in task.fields if f.columns}, "compare_fields": list(task.compare)}


def write_declaration(task: Task, path: str) -> None:
    with open(path, "w", encoding="utf-8") as file:
        json.dump(declaration(task), file, ensure_ascii=False, indent=2)


#: First parts of model names, which are no paths.
MODEL_MAKERS = (
    "gemini/", "openai/", "anthropic/", "huggingface/", "ollama/", "openrouter/", "meta-llama/", "google/", "mistral/", "cohere/", "together/", "anyscale/", "deepseek/", "qwen/", "yi/", "baichuan/",
    "01-ai/", "teknium/", "nousresearch/", "lmsys/", "upstage/",
)


def resolved_paths(config: object, base: str) -> object:
    """Relative paths in a configuration, at any depth, below a folder; addresses and model names are none."""
    if isinstance(config, dict):
        return {k: resolved_paths(v, base) for k, v in config.items()}
    if isinstance(config, list):
        return [resolved_paths(v, base) if isinstance(v, str) else v for v in config]
    is_path = isinstance(config, str) and "/" in config and not config.startswith(("http://", "https://", "/")) and not config.lower().startswith(MODEL_MAKERS)
    return os.path.join(base, config) if is_path else config


def merged_config(*parts: dict) -> dict:
    """Nested mappings merged, later ones winning."""
    out: dict = {}
    for part in parts:
        for key, value in part.items():
            out[key] = merged_config(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def config_folder(folder: str) -> dict:
    """All JSON files of a folder, and YAML ones where a YAML library is installed, merged in the order of their names."""
    parts = []
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), encoding="utf-8") as file:
            if name.endswith(".json"):
                parts.append(json.load(file))
            elif name.endswith((".yaml", ".yml")):
                import yaml

                parts.append(yaml.safe_load(file) or {})
    return merged_config(*parts)
