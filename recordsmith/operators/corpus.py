"""Documents, splits and ground truth: conversion, grouping, reconciliation, sampling, profiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import as_type, first_filled
from .ordering import chunked, ranked, selected


@dataclass(frozen=True)
class Field:
    """A declared field: its type, the columns it may stand in, and what its values must meet."""

    name: str
    kind: str = "str"
    required: bool = False
    columns: Sequence[str] = ()
    choices: Sequence[str] = ()
    low: float | None = None
    high: float | None = None
    pattern: str | None = None
    default: object = None


@dataclass(frozen=True)
class Task:
    """Declared fields of a record, and those that are compared."""

    name: str
    fields: Sequence[Field]
    compare: Sequence[str] = field(default_factory=tuple)

    def problems(self) -> list[str]:
        """What is wrong with the declaration; empty if nothing."""
        names = [f.name for f in self.fields]
        out = [f"field {n} is declared twice" for n in sorted({n for n in names if names.count(n) > 1})]
        out += [f"compared field {n} is not declared" for n in self.compare if n not in names]
        for f in self.fields:
            if f.kind not in ("str", "int", "float", "bool"):
                out.append(f"field {f.name} has no such type: {f.kind}")
            if f.choices and f.kind != "str":
                out.append(f"field {f.name} has choices but is no text")
            if f.low is not None and f.high is not None and f.low > f.high:
                out.append(f"field {f.name} has an empty range")
        return out

    def numeric(self) -> dict[str, bool]:
        kinds = {f.name: f.kind in ("int", "float") for f in self.fields}
        return {n: kinds[n] for n in (self.compare or kinds)}


def converted(rows: DataFrame, task: Task, keep: Sequence[str] = ()) -> DataFrame:
    """Table columns -> the declared fields, with ``problem``: null, or the first field at fault and why.

    A field's value is the first of its columns that is neither null nor empty; a text that is not of the type counts as
    missing (the default, if any).  Column names are compared without case.
    """
    have = {c.lower().strip(): c for c in rows.columns}
    values, faults = [], []
    for f in task.fields:
        found = [F.col(f"`{have[c.lower()]}`") for c in (f.columns or (f.name,)) if c.lower() in have]
        value = as_type(first_filled(found), f.kind) if found else F.lit(None).cast("string")
        value = F.coalesce(value, F.lit(f.default)) if f.default is not None else value
        values.append(value.alias(f.name))
        if f.required:
            faults.append(F.when(value.isNull(), f"{f.name}: missing"))
        if f.choices:
            faults.append(F.when(value.isNotNull() & ~value.isin(*f.choices), f"{f.name}: not a choice"))
        if f.low is not None or f.high is not None:
            outside = (value < f.low if f.low is not None else F.lit(False)) | (value > f.high if f.high is not None else F.lit(False))
            faults.append(F.when(outside, f"{f.name}: out of range"))
        if f.pattern:
            faults.append(F.when(~value.rlike(f.pattern), f"{f.name}: wrong form"))
    return rows.select(*keep, *values, (F.coalesce(*faults) if faults else F.lit(None).cast("string")).alias("problem"))


def grouped_last_wins(rows: DataFrame, raw_id: str, key: Column, pos: str, record: Column) -> DataFrame:
    """(key, raw_id, n, records): records of each raw id in the order of ``pos``; of raw ids that share a key, the last.

    Rows without raw id go.
    """
    some = rows.where(F.col(raw_id).isNotNull()).select(key.alias("key"), raw_id, F.struct(F.col(pos), record.alias("record")).alias("r"))
    last = some.groupBy("key").agg(F.max(raw_id).alias(raw_id))
    groups = some.join(last, ["key", raw_id]).groupBy("key", raw_id).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("r")).alias("r"))
    return groups.select("key", raw_id, "n", F.transform("r", lambda x: x["record"]).alias("records"))


def grouped_in_chunks(rows: DataFrame, raw_id: str, key: Column, pos: str, record: Column, size: int = 1000) -> DataFrame:
    """(key, raw_id, chunk, first, n, chunks, total, values): as grouped_last_wins, with records in chunks, for groups of any size."""
    some = rows.where(F.col(raw_id).isNotNull()).select(key.alias("key"), F.col(raw_id).alias("raw_id"), F.col(pos).alias("pos"), record.alias("record"))
    last = some.groupBy("key").agg(F.max("raw_id").alias("raw_id"))
    return chunked(some.join(last, ["key", "raw_id"], "left_semi"), ["key", "raw_id"], [F.col("pos"), F.col("record")], F.col("record"), size)


def coverage(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """(covered, missing, extra, percentage): how many wanted keys there are, and how many there are besides."""
    w, h = wanted.select(key).distinct().withColumn("w", F.lit(True)), have.select(key).distinct().withColumn("h", F.lit(True))
    sums = w.join(h, key, "full").agg(F.count_if(F.col("w") & F.col("h")).alias("covered"), F.count_if(F.col("w") & F.col("h").isNull()).alias("missing"), F.count_if(F.col("h") & F.col("w").isNull()).alias("extra"))
    return sums.withColumn("percentage", F.coalesce(F.try_divide(100.0 * F.col("covered"), F.col("covered") + F.col("missing")), F.lit(0.0)))


def compared_counts(found: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """(key, found, gold, difference, status) for each key of either side."""
    f, g = found.groupBy(key).agg(F.count(F.lit(1)).alias("found")), gold.groupBy(key).agg(F.count(F.lit(1)).alias("gold"))
    status = F.when(F.col("gold").isNull(), "extra").when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("gold"), "matched").otherwise("different")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return f.join(g, key, "full").select(key, zero("found").alias("found"), zero("gold").alias("gold"), (zero("found") - zero("gold")).alias("difference"), status.alias("status"))


def check_build(documents: DataFrame, gold: DataFrame, limit: int | None, seed: int) -> None:
    """An error that names all that is wrong with the inputs of a data set's build."""
    faults = [f"{name} cannot be empty" for name, df in (("documents", documents), ("gold", gold)) if df.isEmpty()]
    if limit is not None and (not isinstance(limit, int) or isinstance(limit, bool) or limit < 1):
        faults.append("limit must be a positive integer or None")
    if not isinstance(seed, int) or isinstance(seed, bool):
        faults.append("seed must be an integer")
    if faults:
        raise ValueError("; ".join(faults))


def with_gold(documents: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """The documents of which there are gold records."""
    return documents.join(gold.select(key).distinct(), key, "left_semi")


def split_report(splits: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """(split, n, missing, valid): keys of each split, and those without a document."""
    have = documents.select(key).distinct().withColumn("have", F.lit(True))
    return splits.select("split", key).distinct().join(have, key, "left").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("have").isNull()).alias("missing")).withColumn("valid", F.col("missing") == 0)


def split_overlap(splits: DataFrame, key: str, main: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """(key, splits) of keys in more than one main split."""
    own = splits.where(F.col("split").isin(*main)).select("split", key).distinct().groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("split")), ",").alias("splits"), F.count(F.lit(1)).alias("n"))
    return own.where("n > 1").select(key, "splits")


def exact_split(documents: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """(key, split): the floor of n * ratio documents are train, by the order of their seeded hashes.

    No task sees all rows.
    """
    if not 0 <= ratio <= 1:
        raise ValueError("ratio must be between 0 and 1")
    hashed = documents.select(key).distinct().withColumn("_hash", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))))
    placed = ranked(hashed, [], [F.col("_hash"), F.col(key)], "_rank")
    train = int(placed.count() * ratio)
    return placed.select(key, F.when(F.col("_rank") <= train, "train").otherwise("test").alias("split"))


def numeric_profile(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, low, high, median) of each column that has values; the median exact, by selection over all tasks."""
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))).where("value is not null")
    sums = long.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect()  # a row for each column
    middle = {r.column: ((r.n - 1) // 2, r.n // 2) for r in sums}
    at = selected(long, sorted({(c, k) for c, ks in middle.items() for k in ks}))
    out = [(r.column, r.n, r.low, r.high, (at[r.column, middle[r.column][0]] + at[r.column, middle[r.column][1]]) / 2) for r in sums]
    return rows.sparkSession.createDataFrame(out, "column string, n long, low double, high double, median double")


def top_values(rows: DataFrame, column: str, k: int) -> DataFrame:
    """(rank, value, n) of the most frequent values, ties by value."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "value").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "value")))


def value_tail(rows: DataFrame, column: str, k: int, tail: int, seed: int) -> DataFrame:
    """(value, n) of ``tail`` values beyond the k most frequent, by the order of their seeded hashes."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    rest = counts.join(top_values(rows, column, k).select("value"), "value", "left_anti")
    return rest.orderBy(F.md5(F.concat_ws("|", "value", F.lit(str(seed)))), "value").limit(tail)


def seeded_limit(rows: DataFrame, key: str, limit: int, seed: int) -> DataFrame:
    return rows.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(limit)


def dataset_statistics(examples: DataFrame, text: str, records: Column, **others: Column) -> DataFrame:
    """(examples, average_length, average_records, and ``average_`` of each of the others); zeros for none."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    means = {"length": F.length(text), "records": records, **others}
    return examples.agg(F.count(F.lit(1)).alias("examples"), *[zero(F.avg(c)).alias(f"average_{name}") for name, c in means.items()])


def gold_statistics(documents: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """(documents, empty_documents, records, average) of the gold records of each document."""
    n = gold.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    each = documents.select(key).distinct().join(n, key, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return each.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("n") == 0).alias("empty_documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("average"))
