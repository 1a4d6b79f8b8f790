"""Nested JSON states and histories as VARIANT: three layouts to one, entries cleaned, keys dropped at any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import settled

#: The signature of a state that names none, and its fields (prefix, description).
INSTRUCTIONS = "Given the fields `input`, produce the fields `output`."
FIELDS = (("Input:", "${input}"), ("Reasoning: Let's think step by step in order to", "${reasoning}"), ("Output:", "${output}"))
#: Fixed value: the part of an entry that never is kept.
DROPPED = "lm"

_MAP = "map<string,variant>"


def _json(value: str) -> Column:
    return F.parse_json(F.lit(value))


def _object(**parts: Column) -> Column:
    """A VARIANT object; parts that are null are left out."""
    entries = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), v.alias("v"))) for k, v in parts.items()]))
    return F.to_variant_object(F.map_from_entries(entries))


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def is_kind(v: Column, *kinds: str) -> Column:
    """Whether a VARIANT is an OBJECT, an ARRAY, a STRING, ...; false for a missing one."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0).isin(*kinds), F.lit(False))


def filled(v: Column) -> Column:
    """Whether a VARIANT says something: neither missing nor null, false, zero or empty."""
    text = F.to_json(v)
    return F.coalesce(~F.is_variant_null(v) & ~text.isin("false", "{}", "[]", '""') & ~text.rlike(r"^-?0(\.0*)?([eE].*)?$"), F.lit(False))


def _signature() -> Column:
    fields = F.array(*[_object(prefix=F.lit(p).cast("variant"), description=F.lit(d).cast("variant")) for p, d in FIELDS])
    return _object(instructions=F.lit(INSTRUCTIONS).cast("variant"), fields=F.to_variant_object(fields))


def normal_states(states: DataFrame, text: str = "state") -> DataFrame:
    """(..., state) -> (..., layout, state): a state's JSON in its native layout, as VARIANT.

    ``native``: some key begins with prog. and the state stays as it is.  ``nested``: prog holds predict, whose missing parts
    get their defaults; what else prog holds becomes a key of its own.  ``flat``: lm, traces or settings stand at the top;
    traces that are no list, and an lm that is no object, count as none.  ``unknown``: no such layout; ``invalid``: no JSON.
    Of the last two, and of null, the state is null.  An empty table gives no rows.
    """
    v = F.col("_v")
    top, prog = _get(v, "$", _MAP), _get(v, "$.prog", _MAP)
    named = lambda m, *keys: F.coalesce(F.arrays_overlap(F.map_keys(m), F.array(*map(F.lit, keys))), F.lit(False))
    native = F.coalesce(F.exists(F.map_keys(top), lambda k: k.startswith("prog.")), F.lit(False))
    nested = is_kind(_get(v, "$.prog.predict"), "OBJECT")
    layout = F.when(v.isNull(), "invalid").when(native, "native").when(nested, "nested").when(named(top, "lm", "traces", "settings"), "flat").otherwise("unknown")

    own = _get(v, "$.prog.predict", _MAP)
    empty = F.create_map(F.lit("signature"), _signature(), F.lit("traces"), _json("[]"), F.lit("train"), _json("[]"), F.lit("demos"), _json("[]"), F.lit("lm"), _json("null"))
    predict = F.map_concat(F.map_filter(empty, lambda k, _: ~F.array_contains(F.map_keys(own), k)), own)
    others = F.transform_keys(F.map_filter(prog, lambda k, _: k != "predict"), lambda k, _: F.concat(F.lit("prog."), k))
    from_nested = F.to_variant_object(F.map_concat(F.create_map(F.lit("prog.predict"), F.to_variant_object(predict)), others))

    traces, lm, settings = (_get(v, f"$.{k}") for k in ("traces", "lm", "settings"))
    flat = _object(
        traces=F.when(is_kind(traces, "ARRAY"), traces).otherwise(_json("[]")), train=_json("[]"), signature=_signature(),
        lm=F.when(is_kind(lm, "OBJECT"), lm).otherwise(_json("null")),
    )
    from_flat = _object(**{"prog.predict": flat, "_settings": F.when(filled(settings), settings)})

    rows = states.withColumn("_v", F.try_parse_json(text)).withColumn("layout", layout)
    state = F.when(F.col("layout") == "native", v).when(F.col("layout") == "nested", from_nested).when(F.col("layout") == "flat", from_flat)
    return rows.withColumn(text, state).drop("_v")


def without_key(df: DataFrame, by: str, column: str, key: str = DROPPED) -> DataFrame:
    """The same rows, without entries of a key in any object of a VARIANT column, however deep.

    ``by`` names each row.  Only values whose text holds the key are opened: level by level their parts become rows, those under the
    key go, and objects and lists are put together again from the innermost level outwards.  Each level is one round with its
    lineage cut, so there are as many rounds as levels.
    """
    rows = df.withColumn("_opens", F.coalesce(F.to_json(column).contains(f'"{key}"'), F.lit(False)))
    opened = settled(rows.where("_opens").select(F.col(by).alias("by"), F.lit("").alias("node"), F.lit(None).cast("string").alias("up"), F.lit(None).cast("string").alias("key"), F.lit(0).alias("pos"), F.col(column).alias("value")))
    levels = [opened]
    while True:
        inside = levels[-1].where(is_kind(F.col("value"), "OBJECT", "ARRAY")).select("by", F.col("node").alias("up"), "value")
        parts = df.sparkSession.sql("SELECT t.by, t.up, e.pos, e.key, e.value FROM {t} t, LATERAL variant_explode(t.value) e", t=inside)
        parts = parts.where(F.coalesce(F.col("key") != key, F.lit(True))).select("by", F.concat_ws("/", "up", F.col("pos").cast("string")).alias("node"), "up", "key", "pos", "value")
        parts = settled(parts)
        if parts.isEmpty():
            break
        levels.append(parts)
    whole = None
    for level in reversed(levels):
        if whole is not None:
            entries = F.collect_list(F.struct("key", "value"))
            items = F.array_sort(F.collect_list(F.struct("pos", "value")), lambda a, b: a["pos"] - b["pos"])
            made = whole.groupBy("by", F.col("up").alias("node")).agg(F.to_variant_object(F.map_from_entries(F.filter(entries, lambda e: e["key"].isNotNull()))).alias("object"), F.to_variant_object(F.transform(items, lambda x: x["value"])).alias("list"))
            level = level.join(made, ["by", "node"], "left")
        else:
            level = level.withColumn("object", F.lit(None).cast("variant")).withColumn("list", F.lit(None).cast("variant"))
        value = F.when(is_kind(F.col("value"), "OBJECT"), F.coalesce("object", _json("{}"))).when(is_kind(F.col("value"), "ARRAY"), F.coalesce("list", _json("[]"))).otherwise(F.col("value"))
        whole = level.withColumn("value", value).drop("object", "list")
    clean = whole.select(F.col("by").alias(by), F.col("value").alias("_clean"))
    joined = rows.join(clean, by, "left")
    return joined.select(*[F.when(F.col("_opens"), F.col("_clean")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in df.columns])


def clean_history(entries: DataFrame, by: str, text: str = "entry") -> DataFrame:
    """(..., entry) -> the same with entries of messages, outputs, model and other arguments, as VARIANT.

    Missing messages and outputs are empty lists, a missing model an empty text; of the arguments, messages are left out,
    and the whole part if nothing else stands in it.  Nothing under ``lm`` is kept, however deep.  What is no JSON object is null.
    """
    v = F.col("_v")
    extra = F.map_filter(_get(v, "$.kwargs", _MAP), lambda k, _: k != "messages")
    or_else = lambda path, default: F.coalesce(_get(v, path), _json(default))
    entry = _object(messages=or_else("$.messages", "[]"), outputs=or_else("$.outputs", "[]"), model=or_else("$.model", '""'), kwargs=F.when(F.size(extra) > 0, F.to_variant_object(extra)))
    rows = entries.withColumn("_v", F.try_parse_json(text)).withColumn(text, F.when(is_kind(v, "OBJECT"), entry)).drop("_v")
    return without_key(rows, by, text)
