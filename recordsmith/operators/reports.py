"""Findings and counters of datasets, batches, insertions and candidate evaluations; crops put together; joined answers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: empty pixels between the parts of a crop.
GAP_PIXELS = 40
#: Splits in the order in which each may not overlap those before, and the least size of a validation split.
MAIN_SPLITS, SMALL_VALIDATION = ("train", "val", "test"), 3
#: Reasons that mean a figure without tables.
NO_TABLES = ("no_tables", "failed", "crop_failed", "no_extractable_chart")


def document_inputs(wanted: DataFrame, documents: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """(key, outcome) of each wanted id: missing_document, blank_document, missing_gold or kept."""
    ids = wanted.select(key).distinct()
    texts = documents.groupBy(key).agg(F.max(F.length(F.trim("text"))).alias("length"), F.lit(True).alias("here"))
    known = gold.select(key).distinct().withColumn("gold", F.lit(True))
    outcome = (
        F.when(F.col("here").isNull(), "missing_document").when(F.coalesce("length", F.lit(0)) == 0, "blank_document")
        .when(F.col("gold").isNull(), "missing_gold").otherwise("kept")
    )
    return ids.join(texts, key, "left").join(known, key, "left").select(key, outcome.alias("outcome"))


def analysis_inputs(wanted: DataFrame, documents: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """(key, records): wanted documents that exist, with the number of their gold records, none too."""
    counts = gold.groupBy(key).agg(F.count(F.lit(1)).alias("records"))
    there = documents.select(key).distinct().join(wanted.select(key).distinct(), key, "left_semi")
    return there.join(counts, key, "left").select(key, F.coalesce("records", F.lit(0)).alias("records"))


def stopped_batch(calls: DataFrame, batch: str, pos: str, status: str) -> DataFrame:
    """With ``outcome``: as the status says, but ``stopped`` from a batch's first open circuit on."""
    first = calls.where(F.col(status) == "open").groupBy(batch).agg(F.min(pos).alias("_open"))
    return calls.join(first, batch, "left").withColumn("outcome", F.when(F.col(pos) >= F.col("_open"), "stopped").otherwise(F.col(status))).drop("_open")


def batch_counters(calls: DataFrame, batch: str, outcome: str = "outcome", names: Sequence[str] = ("success", "failed", "skipped", "stopped")) -> DataFrame:
    """(batch, a count for each name, total)."""
    return calls.groupBy(batch).agg(*[F.count_if(F.col(outcome) == n).alias(n) for n in names], F.count(F.lit(1)).alias("total"))


def split_findings(splits: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """(severity, rule, subject, n) on (split, key) rows against gold documents; only findings, so that none means valid.

    Errors: ids without gold, ids of train, val and test that an earlier one of these has, no train or val split.
    Warnings: a very small val split, gold documents in no split.
    """
    rows = splits.select("split", key).distinct()
    known = gold.select(key).distinct()
    order = reduce(lambda c, s: c.when(F.col("split") == s, MAIN_SPLITS.index(s)), MAIN_SPLITS[1:], F.when(F.col("split") == MAIN_SPLITS[0], 0))
    placed = rows.withColumn("place", order)
    earliest = placed.where("place is not null").groupBy(key).agg(F.min("place").alias("first"))
    again = placed.join(earliest, key).where("place > first")
    counted = lambda df, severity, rule: df.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.col("split").alias("subject"), "n")
    sizes = rows.groupBy().agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val")])
    required = F.array_compact(F.array(
        *[F.when(F.col(s) == 0, F.struct(F.lit("error").alias("severity"), F.lit("empty_split").alias("rule"), F.lit(s).alias("subject"), F.col(s).alias("n"))) for s in ("train", "val")],
        F.when((F.col("val") > 0) & (F.col("val") < SMALL_VALIDATION), F.struct(F.lit("warning").alias("severity"), F.lit("small_split").alias("rule"), F.lit("val").alias("subject"), F.col("val").alias("n"))),
    ))
    unused = known.join(rows, key, "left_anti").groupBy().agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    found = [
        counted(rows.join(known, key, "left_anti"), "error", "not_in_gold"), counted(again, "error", "overlap"), sizes.select(F.inline(required)),
        unused.select(F.lit("warning").alias("severity"), F.lit("unused_gold").alias("rule"), F.lit("gold").alias("subject"), "n"),
    ]
    return reduce(DataFrame.unionByName, found)


def merged_findings(*findings: DataFrame) -> DataFrame:
    """One row (success, errors, warnings) over several tables of findings; success without errors."""
    every = reduce(DataFrame.unionByName, findings)
    return every.agg((F.count_if(F.col("severity") == "error") == 0).alias("success"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def merged_statistics(*statistics: DataFrame) -> DataFrame:
    """(name, value) of several reports; of a name that several have, the last one's value."""
    every = [df.select("name", "value", F.lit(i).alias("_place")) for i, df in enumerate(statistics)]
    return reduce(DataFrame.unionByName, every).groupBy("name").agg(F.max_by("value", "_place").alias("value"))


def crop_composites(parts: DataFrame) -> DataFrame:
    """(target, pos, width, height, share) -> (target, parts, width, height, share): parts stand below each other."""
    height = F.sum("height") + GAP_PIXELS * (F.count(F.lit(1)) - 1)
    return parts.groupBy("target").agg(F.count(F.lit(1)).alias("parts"), F.max("width").alias("width"), height.alias("height"), F.sum("share").alias("share"))


def numbered_parts(parts: DataFrame) -> DataFrame:
    """With ``part``: part_0001 and so on, in the order of ``pos`` within a target."""
    return parts.withColumn("part", F.format_string("part_%04d", F.row_number().over(Window.partitionBy("target").orderBy("pos"))))


def result_index(results: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc, pos, target_id, status, tables) of results -> with ``ref``: each different canonical name of a result or of
    its target; results without any name have a null one.  Names are the columns visual_ref and figure of either."""
    theirs = targets.select("doc", "target_id", F.col("visual_ref").alias("_ref"), F.col("figure").alias("_figure")).dropDuplicates(["doc", "target_id"])
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    names = F.array_distinct(F.filter(F.array(*[plain(F.col(c)) for c in ("visual_ref", "figure", "_ref", "_figure")]), lambda x: x != ""))
    return results.join(theirs, ["doc", "target_id"], "left").select("doc", "pos", "target_id", "status", "tables", F.explode_outer(names).alias("ref"))


def insertions(anchors: DataFrame, index: DataFrame, good: Sequence[str] = ("success", "partial")) -> DataFrame:
    """(doc, ref) anchors against the index -> (doc, ref, target_id, reason, results): ``inserted``, or why not.

    Of several results the first by ``pos`` is taken; results without an anchor come with the reason missing_anchor.
    """
    named = index.where("ref is not null")
    chosen = named.groupBy("doc", "ref").agg(F.min_by(F.struct("target_id", "status", "tables"), "pos").alias("r"), F.count(F.lit(1)).alias("results"))
    reason = (
        F.when(F.col("r").isNull(), "missing_extraction_result").when(~F.coalesce(F.col("r.status").isin(*good), F.lit(False)), F.coalesce("r.status", F.lit("failed")))
        .when(F.coalesce("r.tables", F.lit(0)) == 0, "no_tables").otherwise("inserted")
    )
    own = anchors.select("doc", "ref").distinct()
    met = own.join(chosen, ["doc", "ref"], "left").select("doc", "ref", "r.target_id", reason.alias("reason"), F.coalesce("results", F.lit(0)).alias("results"))
    lost = named.join(own, ["doc", "ref"], "left_anti").select("doc", "ref", "target_id", F.lit("missing_anchor").alias("reason"), F.lit(1).cast("long").alias("results"))
    return met.unionByName(lost)


def insertion_summary(rows: DataFrame) -> DataFrame:
    """(doc, inserted, without_tables, missing_anchors, missing_results, several_results)."""
    of = lambda *reasons: F.count_if(F.col("reason").isin(*reasons))
    return rows.groupBy("doc").agg(
        of("inserted").alias("inserted"), of(*NO_TABLES).alias("without_tables"), of("missing_anchor").alias("missing_anchors"),
        of("missing_extraction_result").alias("missing_results"), F.count_if(F.col("results") > 1).alias("several_results"),
    )


def anchor_union(single: DataFrame, blocks: DataFrame) -> DataFrame:
    """All anchors (doc, ref, start, end) of both kinds, with ``kind``; both may hold the same place."""
    columns = ["doc", "ref", "start", "end"]
    return single.select(*columns, F.lit("single").alias("kind")).unionByName(blocks.select(*columns, F.lit("block").alias("kind")))


def joined_chunks(chunks: DataFrame, key: str, pos: str, text: str, done: str) -> DataFrame:
    """(key, text, chunks): the chunks of an answer in order, up to the first that says it is done, or all."""
    until = chunks.groupBy(key).agg(F.min(F.when(F.col(done), F.col(pos))).alias("_until"))
    used = chunks.join(until, key).where(F.col("_until").isNull() | (F.col(pos) <= F.col("_until")))
    parts = F.array_sort(F.collect_list(F.struct(pos, text)))  # an answer's chunks are few
    return used.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: F.coalesce(x[text], F.lit(""))), "").alias("text"), F.count(F.lit(1)).alias("chunks"))


def evaluation_grid(scores: DataFrame, candidates: DataFrame, documents: DataFrame, candidate: str, key: str) -> DataFrame:
    """(candidate, documents, mean_f1, chosen): mean F1 of each candidate over all documents, one without a score counting
    as 0; the best is chosen, of equals the first.  ``candidates`` has a row for each, few."""
    n = documents.select(key).distinct().groupBy().agg(F.count(F.lit(1)).alias("documents"))
    sums = scores.join(documents.select(key).distinct(), key, "left_semi").groupBy(candidate).agg(F.sum("f1").alias("f1"))
    grid = candidates.select(candidate).distinct().join(sums, candidate, "left").join(F.broadcast(n))  # one row
    grid = grid.select(candidate, "documents", F.coalesce(F.try_divide(F.coalesce("f1", F.lit(0.0)), F.col("documents")), F.lit(0.0)).alias("mean_f1"))
    best = grid.agg(F.min_by(candidate, F.struct(-F.round("mean_f1", 9), F.col(candidate))).alias("best"))
    return grid.join(F.broadcast(best)).select(candidate, "documents", "mean_f1", (F.col(candidate) == F.col("best")).alias("chosen"))


def figure_label(*labels: Column, fallback: Column) -> Column:
    """The first label that is not blank, in lower case with single blanks; else the fallback."""
    plain = [F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))) for c in labels]
    return F.coalesce(*[F.when(c != "", c) for c in plain], fallback)


def rules_of(rules: DataFrame, level: str | None = None, field: str | None = None) -> DataFrame:
    """Rules of the entity (no field) or of fields, or of one field."""
    if level:
        rules = rules.where(F.col("field").isNull() if level == "entity" else F.col("field").isNotNull())
    return rules if field is None else rules.where(F.col("field") == field)
