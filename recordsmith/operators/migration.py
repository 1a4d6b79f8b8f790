"""Migration of states through a chain of versions, and of tables to known formats, with reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import settled
from .states import is_kind

#: The present version, and the key at the top of a state that says so where no version is named.
CURRENT, CURRENT_KEY = "1.0", "dspy"
#: A step: rows with a VARIANT column ``state`` of one version -> the same rows with states of a later one.
Step = Callable[[DataFrame], DataFrame]
_MAP = "map<string,variant>"


def version_of(state: Column) -> Column:
    """The version that a state names, else the present one if the state has its key, else null."""
    named = F.try_variant_get(state, "$.version", "variant")
    return F.when(named.isNotNull(), F.try_variant_get(state, "$.version", "string")).when(F.try_variant_get(state, f"$.{CURRENT_KEY}", "variant").isNotNull(), CURRENT)


def with_keys(state: Column, drop: Sequence[str] = (), **put: Column) -> Column:
    """A VARIANT object without some keys and with others; a null value puts nothing."""
    own = F.map_filter(F.try_variant_get(state, "$", _MAP), lambda k, _: ~k.isin(*drop, *put))
    new = F.map_from_entries(F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), v.alias("v"))) for k, v in put.items()]))) if put else None
    return F.to_variant_object(own if new is None else F.map_concat(own, new))


def migrated_states(rows: DataFrame, steps: Mapping[str, Step], text: str = "state", current: str = CURRENT) -> DataFrame:
    """(..., state JSON) -> (..., state VARIANT, from_version, to_version, trail, outcome).

    In each round the rows of every older version for which there is a step go through it, and their version is read anew;
    a step that leaves none has made the present one.  Rounds go on until no row has a step left; each is kept before the
    next.  ``outcome``: ``up_to_date``; ``migrated``; ``no_path``, where the chain ends early; ``no_version``, left as it is; ``invalid``, no
    JSON object, state null.  ``trail`` has the versions passed.  Steps that lead in a circle are an error.  No rows: no rows.
    """
    v = F.try_parse_json(text)
    rows = rows.withColumn(text, F.when(is_kind(v, "OBJECT"), v)).withColumn("from_version", version_of(F.col(text)))
    # texts are parsed once, not for each step and each column that names them
    todo = settled(rows.withColumn("to_version", F.col("from_version")).withColumn("trail", F.when(F.col("from_version").isNotNull(), F.array("from_version")).otherwise(F.array().cast("array<string>"))))
    n = max(todo.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism)
    old = [s for s in steps if s != current]
    going = F.coalesce(F.col("to_version").isin(*old), F.lit(False)) if old else F.lit(False)
    ended = [todo.where(~going)]
    open_ = todo.where(going)
    for _ in range(len(old)):
        if open_.isEmpty():
            break
        moved = [steps[s](open_.where(F.col("to_version") == s)).select(*todo.columns) for s in old]
        now = F.coalesce(version_of(F.col(text)), F.lit(current))
        state = F.when(version_of(F.col(text)).isNull(), with_keys(F.col(text), version=F.lit(current).cast("variant"))).otherwise(F.col(text))
        moved = settled(reduce(DataFrame.unionByName, moved).coalesce(n).withColumn("to_version", now).withColumn(text, state).withColumn("trail", F.concat("trail", F.array("to_version"))))
        ended.append(moved.where(~going))
        open_ = moved.where(going)
    if old and not open_.isEmpty():
        raise ValueError("the steps lead in a circle")
    done = reduce(DataFrame.unionByName, ended)
    same = F.col("to_version") == current
    outcome = F.when(F.col(text).isNull(), "invalid").when(F.col("to_version").isNull(), "no_version").when(same & (F.size("trail") == 1), "up_to_date").when(same, "migrated").otherwise("no_path")
    return done.withColumn("outcome", outcome)


def migration_report(rows: DataFrame, by: str, steps: Mapping[str, Step], text: str = "state", current: str = CURRENT, dry_run: bool = True) -> DataFrame:
    """(by, action, status, from_version, to_version, steps, outcome) of each state.

    A dry run looks at versions only and runs no step: what is not at the present version would be migrated.  Else the chain
    runs; a state that cannot be read is ``failed``.  Up-to-date states are skipped.
    """
    if dry_run:
        v = F.try_parse_json(text)
        seen = rows.select(by, version_of(F.when(is_kind(v, "OBJECT"), v)).alias("from_version"))
        fresh = F.coalesce(F.col("from_version") == current, F.lit(False))
        return seen.select(by, F.when(fresh, "skip").otherwise("would_migrate").alias("action"), F.when(fresh, "up_to_date").otherwise("success").alias("status"), "from_version", F.col("from_version").alias("to_version"), F.lit(0).cast("long").alias("steps"))
    done, fresh = migrated_states(rows, steps, text, current), F.col("outcome") == "up_to_date"
    status = F.when(fresh, "up_to_date").when(F.col("outcome") == "invalid", "failed").otherwise("success")
    return done.select(by, F.when(fresh, "skip").otherwise("migrated").alias("action"), status.alias("status"), "from_version", "to_version", F.greatest(F.size("trail") - 1, F.lit(0)).cast("long").alias("steps"))


def format_report(tables: DataFrame, by: str, formats: Mapping[str, Sequence[str]]) -> DataFrame:
    """(by, columns array) -> (by, task, action, status, missing): the format that a table's columns fit.

    The first format, in the order given, all of whose columns are there; else the first of which more than half are;
    else none.  ``missing``: the format's columns that a migration would add.
    """
    both = {t: F.size(F.array_intersect("columns", F.array(*map(F.lit, names)))) for t, names in formats.items()}
    whole = F.coalesce(*[F.when(both[t] == len(set(names)), t) for t, names in formats.items()])
    part = F.coalesce(*[F.when(both[t] > len(set(names)) * 0.5, t) for t, names in formats.items()])
    task = F.coalesce(whole, part)
    missing = F.coalesce(*[F.when(F.col("task") == t, F.array_join(F.array_except(F.array(*map(F.lit, names)), "columns"), ",")) for t, names in formats.items()])
    found = F.col("task").isNotNull()
    return tables.withColumn("task", task).select(by, "task", F.when(found, "would_migrate").otherwise("skip").alias("action"), F.when(found, "success").otherwise("unknown_format").alias("status"), missing.alias("missing"))
