"""Figures of documents: manifests, anchors in text, targets, tables put in place, reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_ref, cell, column_title, panel_key, shortened
from .states import filled, is_kind

#: Relevance from weak to strong.
RELEVANCE = ("unlikely", "possible", "likely")


def relevance_rank(c: Column) -> Column:
    """1 to 3; anything else is 0."""
    text = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = F.lit(0)
    for rank, name in enumerate(RELEVANCE, 1):
        out = F.when(text == name, rank).otherwise(out)
    return out


def relevance_name(rank: Column) -> Column:
    return F.when(rank >= 1, F.element_at(F.array(*map(F.lit, RELEVANCE)), F.greatest(rank, F.lit(1)))).otherwise("")


def route(numeric: Column, relevance: Column) -> Column:
    return F.when(~F.coalesce(numeric, F.lit(False)), "skip_not_numeric").when(relevance == "unlikely", "skip_unlikely").otherwise("extract")


def merged_manifest(rows: DataFrame) -> DataFrame:
    """(doc, pos, figure, pages, caption, numeric, relevance) -> a row for each figure of a document.

    Pages in order without repetition, the longest caption (the first of equals), numeric if any is, the strongest
    relevance, the first position, and how many rows were merged.
    """
    g = rows.groupBy("doc", "figure").agg(
        F.min("pos").alias("pos"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"),
        F.max(F.struct(F.length("caption").alias("n"), (-F.col("pos")).alias("p"), "caption")).alias("best"),
        F.coalesce(F.bool_or("numeric"), F.lit(False)).alias("numeric"), F.max(relevance_rank(F.col("relevance"))).alias("rank"), F.count(F.lit(1)).alias("merged"),
    )
    out = g.select("doc", "figure", "pos", "pages", F.col("best.caption").alias("caption"), "numeric", relevance_name(F.col("rank")).alias("relevance"), "merged")
    return out.withColumn("routing", route(F.col("numeric"), F.col("relevance")))


def panel_rollup(rows: DataFrame) -> DataFrame:
    """A figure's ``numeric`` and ``relevance`` are at least those of its panels; two columns tell what was raised."""
    any_numeric = F.exists("panels", lambda p: F.coalesce(p["numeric"], F.lit(False)))
    rank = F.greatest(relevance_rank(F.col("relevance")), F.coalesce(F.array_max(F.transform("panels", lambda p: relevance_rank(p["relevance"]))), F.lit(0)))
    own = F.coalesce("numeric", F.lit(False))
    return rows.withColumn("raised_numeric", any_numeric & ~own).withColumn("raised_relevance", rank > relevance_rank(F.col("relevance"))).withColumn("numeric", own | any_numeric).withColumn("relevance", relevance_name(rank))


def spans(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc, text) -> (doc, pos, start, end, groups): every match of a pattern, offsets in characters from 0.

    What stands between the matches says where they are, so nothing but the pattern is looked for.  The pattern matches no
    empty text; groups that take no part are empty.
    """
    dotall, n = f"(?s){pattern}", re.compile(pattern).groups
    found = F.transform(F.split("text", dotall, -1), F.length)
    every = lambda g: F.regexp_extract_all("text", F.lit(f"(?s)({pattern})" if g == 0 else dotall), F.lit(1 if g == 0 else g))
    columns = docs.select("doc", found.alias("between"), every(0).alias("whole"), F.array(*[every(g + 1) for g in range(n)]).alias("parts")).where(F.size("whole") > 0)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    place = lambda acc, x: F.struct((acc["at"] + x["b"] + F.length(x["m"])).alias("at"), F.array_append(acc["starts"], acc["at"] + x["b"]).alias("starts"))
    pairs = F.zip_with(F.slice("between", F.lit(1), F.size("whole")), "whole", lambda b, m: F.struct(b.alias("b"), m.alias("m")))
    rows = columns.select("doc", F.posexplode(F.arrays_zip(F.aggregate(pairs, start, place, lambda acc: acc["starts"]).alias("start"), F.col("whole").alias("m"))).alias("pos", "x"), "parts")
    return rows.select("doc", "pos", F.col("x.start").alias("start"), (F.col("x.start") + F.length("x.m")).alias("end"), F.transform("parts", lambda p: p[F.col("pos")]).alias("groups"))


def paired_blocks(marks: DataFrame) -> DataFrame:
    """(doc, pos, kind BEGIN or END, label, start, end) -> one row for each pair, and for each mark that pairs with none.

    A BEGIN with a label and the END right after it are a block if their labels agree, else one label_mismatch.
    Otherwise: empty_begin_label, nested_or_missing_end (a BEGIN follows), missing_end (nothing follows), unmatched_end.
    """
    w = Window.partitionBy("doc").orderBy("pos")
    ref = canonical_ref(F.col("label"))
    m = marks.withColumn("ref", ref)
    for name, f in (("next", F.lead), ("before", F.lag)):
        m = m.withColumn(f"{name}_kind", f("kind").over(w)).withColumn(f"{name}_ref", f("ref").over(w))
    m = m.withColumn("close", F.lead("start").over(w)).withColumn("close_end", F.lead("end").over(w))
    begin = F.col("kind") == "BEGIN"
    taken = ~begin & (F.col("before_kind") == "BEGIN") & (F.col("before_ref") != "")
    what = (
        F.when(begin & (F.col("ref") == ""), "empty_begin_label").when(begin & F.col("next_kind").isNull(), "missing_end").when(begin & (F.col("next_kind") == "BEGIN"), "nested_or_missing_end")
        .when(begin & (F.col("next_ref") != F.col("ref")), "label_mismatch").when(begin, "block").otherwise("unmatched_end")
    )
    out = m.where(~F.coalesce(taken, F.lit(False))).withColumn("outcome", what)
    pair = F.col("outcome").isin("block", "label_mismatch")
    return out.select("doc", "pos", "ref", "outcome", "start", F.col("end").alias("content_start"), F.when(pair, F.col("close")).alias("content_end"), F.when(pair, F.col("close_end")).otherwise(F.col("end")).alias("end"))


def unique_refs(anchors: DataFrame, *by: str) -> DataFrame:
    """With ``occurrences`` of each reference among the same ``by``; an index takes those that occur once."""
    return anchors.withColumn("occurrences", F.count(F.lit(1)).over(Window.partitionBy(*by, "ref")))


def gated_targets(manifest: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc, pos, figure, routing) and anchors (doc, ref) -> (doc, target_id, ref, outcome) of figures that are to be
    extracted: target, skipped_duplicate or skipped_no_anchor.  A target's number is its figure's in the whole manifest."""
    number = F.row_number().over(Window.partitionBy("doc").orderBy("pos"))
    rows = manifest.withColumn("target_id", F.format_string("target_%04d", number)).withColumn("ref", canonical_ref(F.col("figure"))).where("routing = 'extract'")
    n = anchors.groupBy("doc", "ref").agg(F.count(F.lit(1)).alias("n"))
    outcome = F.when(F.col("n").isNull(), "skipped_no_anchor").when(F.col("n") > 1, "skipped_duplicate").otherwise("target")
    return rows.join(n, ["doc", "ref"], "left").select("doc", "target_id", "ref", outcome.alias("outcome"))


def gate_report(manifest: DataFrame, anchors: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc, outcome, n): targets by outcome, and anchors that no figure names."""
    loose = anchors.select("doc", "ref").distinct().join(manifest.select("doc", canonical_ref(F.col("figure")).alias("ref")), ["doc", "ref"], "left_anti")
    counted = targets.select("doc", "outcome").unionByName(loose.select("doc", F.lit("anchor_without_figure").alias("outcome")))
    return counted.groupBy("doc", "outcome").agg(F.count(F.lit(1)).alias("n"))


def rendered_table(columns: Column, rows: Column) -> Column:
    """Markdown of a table: columns array<struct<name, unit>>, rows array<array<string>>, cut or filled to its width."""
    n = F.size(columns)
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    body = F.transform(rows, lambda r: line(F.slice(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), n)), 1, n)))
    head = line(F.transform(columns, lambda c: column_title(c["name"], c["unit"])))
    return F.array_join(F.concat(F.array(head, line(F.array_repeat(F.lit("---"), n))), body), "\n")


def ragged(columns: Column, rows: Column) -> Column:
    """How many rows are not as wide as the table."""
    return F.size(F.filter(rows, lambda r: F.size(r) != F.size(columns)))


def result_blocks(results: DataFrame) -> DataFrame:
    """(..., label, result JSON) -> (..., block, warnings): Markdown of a result's tables under its figure's name, else its label.

    Each table stands under its panel or, if there are several, as that of the whole figure.  Tables that are no objects or
    have no columns, rows that are no list, and rows of another width give a warning; a row that is no list is one cell.
    A result without a table to show has an empty block.  The result's own warnings stand last.
    """
    get = lambda v, path, kind="variant": F.try_variant_get(v, f"$.{path}", kind)
    many = lambda v: F.when(is_kind(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    plain = lambda v: cell(F.when(is_kind(v, "BOOLEAN"), F.initcap(F.to_json(v))).when(is_kind(v, "OBJECT", "ARRAY"), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string")))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    v, target = F.col("_v"), F.coalesce(get(F.col("_v"), "target_id", "string"), F.lit("result"))
    tables = F.coalesce(many(get(v, "tables")), F.array().cast("array<variant>"))

    def header(column: Column) -> Column:
        named = F.when(plain(get(column, "unit")) == "", plain(get(column, "name"))).otherwise(F.concat(plain(get(column, "name")), F.lit(" ("), plain(get(column, "unit")), F.lit(")")))
        return F.when(is_kind(column, "OBJECT"), named).otherwise(plain(column))

    def one(table: Column) -> Column:
        columns, given = many(get(table, "columns")), get(table, "rows")
        has = F.coalesce(F.size(columns) > 0, F.lit(False))
        width, rows = F.size(columns), F.coalesce(many(given), F.array().cast("array<variant>"))
        cells = lambda r: F.coalesce(many(r), F.array(r))
        body = F.transform(rows, lambda r: line(F.slice(F.concat(F.transform(cells(r), plain), F.array_repeat(F.lit(""), width)), 1, width)))
        text = F.array_join(F.concat(F.array(line(F.transform(columns, header)), line(F.array_repeat(F.lit("---"), width))), body), "\n")
        panel = F.when(filled(get(table, "panel")), F.concat(F.lit("#### Panel "), get(table, "panel", "string"))).when(F.size(tables) > 1, "#### Whole figure")
        uneven = F.array_compact(F.transform(rows, lambda r, i: F.when(F.size(cells(r)) != width, F.concat(target, F.lit(":row_"), (i + 1).cast("string"), F.lit("_column_count_mismatch")))))
        no_list = F.when(given.isNotNull() & ~is_kind(given, "ARRAY"), F.concat(target, F.lit(":table_rows_not_list")))
        notes = F.when(has, F.concat(F.array_compact(F.array(no_list)), uneven)).otherwise(F.array(F.concat(target, F.lit(":table_missing_columns"))))
        shown = F.concat_ws("\n\n", panel, F.when(has, text))
        bare = F.struct(F.lit("").alias("text"), F.array(F.concat(target, F.lit(":table_not_object"))).alias("notes"))
        return F.when(is_kind(table, "OBJECT"), F.struct(shown.alias("text"), notes.alias("notes"))).otherwise(bare)

    made = results.withColumn("_v", F.try_parse_json("result")).withColumn("_tables", F.transform(tables, one)).withColumn("_own", many(get(v, "warnings")))
    shown = F.filter(F.col("_tables.text"), lambda t: t != "")
    figure = F.when(filled(get(v, "figure")), get(v, "figure", "string")).otherwise(F.col("label"))
    title = F.concat(F.when(F.size("_tables") == 1, "### Extracted table from ").otherwise("### Extracted tables from "), figure)
    own = F.when(F.size("_own") > 0, F.concat(F.lit("\n\n\n_Extraction warnings:_\n"), F.array_join(F.transform("_own", lambda w: F.concat(F.lit("- "), plain(w))), "\n"))).otherwise("")
    block = F.when(F.size(shown) > 0, F.regexp_replace(F.concat(title, F.lit("\n\n"), F.array_join(shown, "\n\n"), own), r"\s+$", "")).otherwise("")
    return made.withColumn("block", block).withColumn("warnings", F.flatten(F.col("_tables.notes"))).drop("_v", "_tables", "_own")


def inserted(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(doc, text) and (doc, content_start, content_end, body), disjoint -> text with each content replaced by its body."""
    own = places.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("content_start", "content_end", "body"))).alias("p"))
    joined = docs.join(own, "doc", "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc: Column, p: Column) -> Column:
        before = F.substring(F.col("text"), acc["at"] + 1, p["content_start"] - acc["at"])
        return F.struct(p["content_end"].alias("at"), F.concat(acc["out"], before, F.lit("\n"), p["body"], F.lit("\n")).alias("out"))

    whole = F.aggregate("p", start, put, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return joined.select("doc", F.coalesce(F.when(F.col("p").isNotNull(), whole), F.col("text")).alias("text"))


def allowed_tables(rows: DataFrame) -> DataFrame:
    """(…, status, panels array<struct<panel, numeric, relevance>>, tables array<struct<panel, …>>): tables of relevant
    panels only.  Without relevant panels all pass; one relevant panel adopts tables without label; nothing left of a
    success is no_extractable_chart, a part of it partial."""
    relevant = F.filter("panels", lambda p: F.coalesce(p["numeric"], F.lit(False)) & (F.coalesce(p["relevance"], F.lit("")) != "unlikely"))
    r = rows.withColumn("allowed", F.array_distinct(F.transform(relevant, lambda p: panel_key(p["panel"]))))
    one = F.size("allowed") == 1
    named = F.transform("tables", lambda t: t.withField("panel", F.when(one & (panel_key(t["panel"]) == ""), F.col("allowed")[0]).otherwise(panel_key(t["panel"]))))
    r = r.withColumn("kept", F.when(F.size("allowed") == 0, F.col("tables")).otherwise(F.filter(named, lambda t: F.array_contains("allowed", t["panel"]))))
    r = r.withColumn("missing_panels", F.array_except("allowed", F.transform("kept", lambda t: t["panel"])))
    done = F.col("status").isin("success", "partial")
    status = F.when(F.size("allowed") == 0, F.col("status")).when(done & (F.size("kept") == 0), "no_extractable_chart").when((F.col("status") == "success") & (F.size("missing_panels") > 0), "partial").otherwise(F.col("status"))
    return r.withColumn("status", status).withColumn("tables", F.col("kept")).drop("kept")


def visual_report(manifest: DataFrame, targets: DataFrame, crops: DataFrame, tables: DataFrame) -> DataFrame:
    """A row for each figure with what became of it."""
    rows = manifest.join(targets.where("outcome = 'target'").select("doc", F.col("ref"), "target_id"), (manifest.doc == targets.doc) & (canonical_ref(manifest.figure) == F.col("ref")), "left").drop(targets.doc)
    rows = rows.join(crops.withColumnsRenamed({"status": "crop_status"}), ["doc", "target_id"], "left").join(tables.withColumnsRenamed({"status": "table_status"}), ["doc", "target_id"], "left")
    skipped = F.when(F.col("routing") != "extract", F.col("routing")).when(F.col("target_id").isNull(), "no_target").when(F.coalesce("crop_status", F.lit("none")) != "success", "crop_failed").when(F.coalesce("table_status", F.lit("none")) != "success", "extraction_failed")
    return rows.select("doc", "figure", "routing", "target_id", "crop_status", "table_status", skipped.alias("skip_reason"), shortened(F.col("caption"), 40).alias("caption"))


def report_summary(report: DataFrame) -> DataFrame:
    return report.agg(F.count(F.lit(1)).alias("figures"), F.count("target_id").alias("targets"), F.count_if(F.col("crop_status") == "success").alias("cropped"), F.count_if(F.col("table_status") == "success").alias("extracted"), F.count("skip_reason").alias("skipped"))
