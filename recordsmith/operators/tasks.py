"""A registry of tasks whose conversion is callable in SQL: functions generated from a declaration, validated together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ..functions.text import NUMBER
from .corpus import Field, Task

#: SQL types of the declared kinds.
KINDS = {"str": "STRING", "int": "BIGINT", "float": "DOUBLE", "bool": "BOOLEAN"}


def literal(value: object) -> str:
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    return "NULL" if value is None else str(value).upper() if isinstance(value, bool) else repr(value)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _name(column: str) -> str:
    return _quoted(column.lower().strip())


def _columns(f: Field) -> list[str]:
    return list(dict.fromkeys(c.lower().strip() for c in (f.columns or (f.name,))))


def _value(f: Field) -> str:
    """SQL of a field's value: the first of its columns that is neither null nor empty, as its type."""
    text = f"coalesce({', '.join(f"nullif({_name(c)}, '')" for c in _columns(f))})"
    typed = {
        "str": text, "bool": f"lower({text}) IN ('true', '1', 'yes')",
        "int": f"CASE WHEN {text} RLIKE {literal(r'^\s*[+-]?\d+\s*$')} THEN try_cast(trim({text}) AS BIGINT) END",
        "float": f"CASE WHEN {text} RLIKE {literal(NUMBER)} THEN try_cast(trim({text}) AS DOUBLE) END",
    }[f.kind]
    return typed if f.default is None else f"coalesce({typed}, {literal(f.default)})"


def _faults(f: Field, value: str) -> list[str]:
    """SQL of what is wrong with a value, each null where nothing is."""
    out = []
    if f.required:
        out.append(f"CASE WHEN {value} IS NULL THEN {literal(f'{f.name}: missing')} END")
    if f.choices:
        out.append(f"CASE WHEN {value} NOT IN ({', '.join(map(literal, f.choices))}) THEN {literal(f'{f.name}: not a choice')} END")
    if f.low is not None or f.high is not None:
        bounds = [f"{value} {sign} {literal(x)}" for sign, x in (("<", f.low), (">", f.high)) if x is not None]
        out.append(f"CASE WHEN {' OR '.join(bounds)} THEN {literal(f'{f.name}: out of range')} END")
    if f.pattern:
        out.append(f"CASE WHEN NOT {value} RLIKE {literal(f.pattern)} THEN {literal(f'{f.name}: wrong form')} END")
    return out


def record_type(task: Task) -> StructType:
    """The type of a task's records; what a field must meet stands in its metadata."""
    kinds = {"str": StringType(), "int": LongType(), "float": DoubleType(), "bool": BooleanType()}
    bounds = lambda f: {k: v for k, v in (("choices", list(f.choices)), ("low", f.low), ("high", f.high), ("pattern", f.pattern)) if v not in (None, [])}
    return StructType([StructField(f.name, kinds[f.kind], not f.required, bounds(f)) for f in task.fields])


def output_type(task: Task) -> StructType:
    """The type of a document's extraction: a list of records under ``experiments``."""
    return StructType([StructField("experiments", ArrayType(record_type(task)))])


def parsed_output(rows: DataFrame, text: str, task: Task) -> DataFrame:
    """(..., JSON) -> (..., experiments): records as the task's type; null for what is no such JSON, and null fields where values do not fit."""
    return rows.withColumn("experiments", F.from_json(text, output_type(task))["experiments"])


class Registry:
    """Tasks by name; each gives the session the temporary SQL functions

    ``convert_<task>_<field>(columns of the field)`` and ``convert_<task>(columns of all fields)``, a struct of the fields and
    ``problem``.  Arguments are texts; a column that several fields read is one argument.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tasks = spark, {}

    def _functions(self, task: Task) -> dict[str, str]:
        parameters = lambda columns: ", ".join(f"{_name(c)} STRING" for c in columns)
        made = {f"convert_{task.name}_{f.name}": f"({parameters(_columns(f))}) RETURNS {KINDS[f.kind]} RETURN {_value(f)}" for f in task.fields}
        inner = ", ".join(f"{_value(f)} AS {_name(f.name)}" for f in task.fields)
        faults = [x for f in task.fields for x in _faults(f, f"v.{_name(f.name)}")]
        fields = ", ".join(f"v.{_name(f.name)}" for f in task.fields)
        problem = f"coalesce({', '.join(faults)})" if faults else "CAST(NULL AS STRING)"
        kinds = ", ".join(f"{_name(f.name)}: {KINDS[f.kind]}" for f in task.fields)
        body = f"(SELECT named_struct({', '.join(f'{literal(f.name)}, v.{_name(f.name)}' for f in task.fields)}, 'problem', {problem}) FROM (SELECT {inner}) v)" if fields else "NULL"
        made[f"convert_{task.name}"] = f"({parameters(self.columns(task))}) RETURNS STRUCT<{kinds}, problem: STRING> RETURN {body}"
        return made

    @staticmethod
    def columns(task: Task) -> list[str]:
        """The columns that a task reads, in the order of its fields."""
        return list(dict.fromkeys(c for f in task.fields for c in _columns(f)))

    def register(self, *tasks: Task) -> None:
        """All of them or, if one is wrongly declared or known already, none."""
        faults = [f"{t.name}: {p}" for t in tasks for p in t.problems()]
        names = [t.name for t in tasks]
        faults += [f"{n}: registered already" for n in sorted({n for n in names if n in self.tasks or names.count(n) > 1})]
        if faults:
            raise ValueError("; ".join(faults))
        for task in tasks:
            for name, rest in self._functions(task).items():
                self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {_quoted(name)}{rest}")
            self.tasks[task.name] = task

    def unregister(self, name: str) -> None:
        if name not in self.tasks:
            raise KeyError(name)
        for function in self._functions(self.tasks.pop(name)):
            self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {_quoted(function)}")

    def names(self) -> list[str]:
        return sorted(self.tasks)

    def converted(self, rows: DataFrame, name: str, keep: Sequence[str] = ()) -> DataFrame:
        """(keep, fields, problem), as operators.corpus.converted() gives them; columns that are not there count as null."""
        have = {c.lower().strip(): c for c in rows.columns}
        arguments = ", ".join(f"CAST({_quoted(have[c])} AS STRING)" if c in have else "CAST(NULL AS STRING)" for c in self.columns(self.tasks[name]))
        return rows.selectExpr(*map(_quoted, keep), f"{_quoted(f'convert_{name}')}({arguments}) AS _made").select(*map(_quoted, keep), "_made.*")
