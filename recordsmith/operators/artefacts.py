"""Rules for the artefacts of a figure pipeline, as declared shapes that run over VARIANT paths.

A shape says where its elements lie, what must hold of each, and which lists below hold further elements.  Checking it
gives a row for each rule that an element breaks, with the element's path.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import valid_box
from .states import filled, is_kind

#: Of an element: null where the rule holds, else the rule's name.
Rule = Callable[[Column], Column]
ERROR, WARNING = "error", "warning"


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def keys(*names: str) -> list[Rule]:
    """Each key stands in the element, be it null."""
    return [lambda v, n=n: F.when(_at(v, n).isNull(), f"missing_key:{n}") for n in names]


def kind(path: str, *kinds: str) -> Rule:
    return lambda v: F.when(~is_kind(_at(v, path), *kinds), f"{path}:not_{kinds[0].lower()}")


def one_of(path: str, *values: str) -> Rule:
    return lambda v: F.when(~F.coalesce(_at(v, path, "string").isin(*values), F.lit(False)), f"invalid:{path}")


def not_value(path: str, value: str) -> Rule:
    return lambda v: F.when(_at(v, path, "string") == value, f"{path}:{value}")


def present(path: str) -> Rule:
    return lambda v: F.when(~filled(_at(v, path)), f"missing:{path}")


def absent(path: str) -> Rule:
    return lambda v: F.when(filled(_at(v, path)), f"has:{path}")


def not_empty(path: str) -> Rule:
    return lambda v: F.when(is_kind(_at(v, path), "ARRAY") & (F.size(_at(v, path, "array<variant>")) == 0), f"{path}:empty")


def box(path: str) -> Rule:
    """A box in shares of a page."""
    return lambda v: F.when(~valid_box(_at(v, f"{path}.norm", "array<double>")), f"invalid:{path}")


@dataclass(frozen=True)
class Shape:
    """``where``: path of a list whose items are the elements, "" for the value itself, "." for a list that the value is."""

    where: str = ""
    errors: tuple[Rule, ...] = ()
    warnings: tuple[Rule, ...] = ()
    inside: tuple[Shape, ...] = ()
    files: tuple[str, ...] = ()  # paths to texts that name files


#: Keys, kinds and values that the artefacts of each stage must have.
SHAPES = {
    "manifest": Shape(".", (*keys("figure", "pages", "caption", "num", "rel", "routing_decision", "panels"), one_of("routing_decision", "extract", "skip"))),
    "targets": Shape(".", tuple(keys("target_id", "figure", "pages", "caption", "num", "rel", "panels", "page_images")), inside=(Shape("page_images", tuple(keys("page", "image_path"))),)),
    "pages": Shape("", (kind("pages", "ARRAY"),), inside=(Shape("pages", tuple(keys("page", "image_path", "width_px", "height_px")), files=("image_path",)),)),
    "boxes": Shape(".", (present("target_id"), kind("parts", "ARRAY"), not_empty("parts")), inside=(Shape("parts", (box("bbox"), box("bbox_with_margin"))),)),
    "crops": Shape(".", (not_value("status", "fail"),), files=("crop_path",)),
    "tables": Shape(".", (*keys("schema_version", "target_id", "figure", "status", "tables", "warnings"), kind("tables", "ARRAY"), kind("warnings", "ARRAY"))),
    "anchors": Shape("", (one_of("schema_version", "aee.md_anchor_index.v1"), kind("anchors", "ARRAY"), kind("index", "OBJECT")), (absent("duplicates"), absent("invalid_blocks"))),
    "report": Shape("", (kind("rows", "ARRAY"), kind("summary", "OBJECT"))),
    "insertion": Shape("", (one_of("schema_version", "aee.visual_table_insertion.v1"), kind("output_markdown", "STRING"), kind("anchors_found", "ARRAY"), kind("summary", "OBJECT"))),
}


def _elements(rows: DataFrame, where: str) -> DataFrame:
    """(by, path, value) -> the same of a list's items, with their places from 1."""
    if not where:
        return rows
    items = rows if where == "." else rows.select("by", F.concat("path", F.lit(f".{where}")).alias("path"), _at(F.col("value"), where).alias("value"))
    items = items.where(is_kind(F.col("value"), "ARRAY"))
    sql = "SELECT t.by, concat(t.path, '[', e.pos + 1, ']') AS path, e.value FROM {t} t, LATERAL variant_explode(t.value) e"
    return rows.sparkSession.sql(sql, t=items)


def _broken(rows: DataFrame, shape: Shape, known: DataFrame | None) -> list[DataFrame]:
    elements, value = _elements(rows, shape.where), F.col("value")
    row = lambda severity, rule: F.when(rule.isNotNull(), F.struct(F.lit(severity).alias("severity"), rule.alias("rule")))
    checks = [row(s, r(value)) for s, rules in ((ERROR, shape.errors), (WARNING, shape.warnings)) for r in rules]
    object_ = is_kind(value, "OBJECT")
    no_object = F.array(F.struct(F.lit(ERROR).alias("severity"), F.lit("not_object").alias("rule")))
    found = elements.select("by", "path", F.inline(F.when(object_, F.array_compact(F.array(*checks))).otherwise(no_object)))
    out = [found]
    if shape.where == ".":
        out.append(rows.where(~is_kind(value, "ARRAY")).select("by", "path", F.lit(ERROR).alias("severity"), F.lit("not_list").alias("rule")))
    for path in shape.files if known is not None else ():
        named = elements.where(object_).select("by", "path", F.coalesce(_at(value, path, "string"), F.lit("")).alias("file"))
        named = named if path == "crop_path" else named.where("file <> ''")
        out.append(named.join(known.select(F.col("path").alias("file")).distinct(), "file", "left_anti").select("by", "path", F.lit(ERROR).alias("severity"), F.lit(f"missing_file:{path}").alias("rule")))
    return out + [x for s in shape.inside for x in _broken(elements.where(object_), s, known)]


def broken_rules(artefacts: DataFrame, by: str, text: str, stage: str, shape: Shape | None = None, files: DataFrame | None = None) -> DataFrame:
    """(by, text) of a stage -> (by, path, severity, rule), a row for each rule that an element breaks.

    Paths begin with $ and count items from 1.  What is no JSON breaks ``no_json``, and null too.  ``files``: (path) of files that
    exist; without it they are not looked for.  Other columns are ignored.  An empty table gives no rows.
    """
    rows = artefacts.select(F.col(by).alias("by"), F.lit("$").alias("path"), F.try_parse_json(text).alias("value"))
    unread = rows.where("value is null").select("by", "path", F.lit(ERROR).alias("severity"), F.lit("no_json").alias("rule"))
    found = _broken(rows.where("value is not null"), shape or SHAPES[stage], files)
    return reduce(DataFrame.unionByName, found, unread).withColumnRenamed("by", by)


def verdicts(artefacts: DataFrame, broken: DataFrame, by: str) -> DataFrame:
    """(by, status, errors, warnings): fail where an error was found, ok else."""
    sums = broken.groupBy(by).agg(F.count_if(F.col("severity") == ERROR).alias("errors"), F.count_if(F.col("severity") == WARNING).alias("warnings"))
    rows = artefacts.select(by).join(sums, by, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(by, F.when(F.coalesce("errors", F.lit(0)) > 0, "fail").otherwise("ok").alias("status"), zero("errors"), zero("warnings"))


#: What a crop's result holds where it says nothing.
CROP_DEFAULTS = {"schema_version": '"aee.figure_crop.v2"', "target_id": '""', "crop_path": '""', "pages": "[]", "parts": "[]", "crop_width_px": "0", "crop_height_px": "0", "crop_area_ratio": "0", "warnings": "[]"}
_MAP = "map<string,variant>"


def with_defaults(v: Column, defaults: Mapping[str, str]) -> Column:
    """A VARIANT object with the JSON given for keys that it does not have; null keys are had."""
    own = F.try_variant_get(v, "$", _MAP)
    empty = F.create_map(*[x for k, text in defaults.items() for x in (F.lit(k), F.parse_json(F.lit(text)))])
    return F.to_variant_object(F.map_concat(F.map_filter(empty, lambda k, _: ~F.array_contains(F.map_keys(own), k)), own))


def normal_crop(v: Column) -> Column:
    """A crop's result with all its keys; without a status it is ``fail`` if it says failed, else ``ok``, and failed goes."""
    full = with_defaults(v, CROP_DEFAULTS)
    own = F.try_variant_get(full, "$", _MAP)
    status = F.when(filled(_at(v, "failed")), "fail").otherwise("ok").cast("variant")
    own = F.when(F.array_contains(F.map_keys(own), "status"), own).otherwise(F.map_concat(own, F.create_map(F.lit("status"), status)))
    return F.to_variant_object(F.map_filter(own, lambda k, _: k != "failed"))


def normal_boxes(v: Column) -> Column:
    """(target, parts) of a result with boxes -> target_id and parts."""
    return F.to_variant_object(F.create_map(F.lit("target_id"), _at(v, "target.target_id"), F.lit("parts"), _at(v, "parts")))


def normal_pages(v: Column) -> Column:
    """dpi as a whole number, and pages, none if not said."""
    return F.to_variant_object(F.create_map(F.lit("dpi"), F.floor(_at(v, "dpi", "double")).cast("long").cast("variant"), F.lit("pages"), F.coalesce(_at(v, "pages"), F.parse_json(F.lit("[]")))))
