"""Scoring of found records against gold ones: pairs, outcomes by field, precision, recall and F1."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_close, normal_text, number
from .assignment import aligned_rows
from .states import is_kind


_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _ready(df: DataFrame, fields: Mapping[str, bool], values: Sequence[Column] | None = None) -> Column:
    """Each field's number, normal text and presence, made once for a record and not for each pair of records; of other
    columns of the same types, if ``values`` are given."""
    kinds, columns = dict(df.dtypes), []
    for (name, numeric), c in zip(fields.items(), values or [F.col(f) for f in fields]):
        if numeric and kinds[name].startswith(_NUMERIC):
            n = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
            columns.append(F.struct(n.alias("n"), F.when(F.isnan(c), "NaN").alias("t"), c.isNotNull().alias("has")).alias(name))
        else:
            t = c.cast("string")
            columns.append(F.struct((number(t) if numeric else F.lit(None).cast("double")).alias("n"), normal_text(t).alias("t"), t.isNotNull().alias("has")).alias(name))
    return F.struct(*columns)


def _same(a: Column, b: Column, numeric: bool) -> Column:
    """Whether two present values match; false where one is absent."""
    text = a["t"] == b["t"]
    both = F.when(a["n"].isNotNull() & b["n"].isNotNull(), is_close(a["n"], b["n"])).otherwise(text) if numeric else text
    return F.coalesce(a["has"] & b["has"] & both, F.lit(False))


def pair_outcomes(found: DataFrame, gold: DataFrame, keys: Sequence[str], fields: Mapping[str, bool]) -> DataFrame:
    """Records paired by ``keys`` -> (keys, field, tp, fp, fn, total, correct), a row for each field of each pair.

    ``fields`` says of each field whether it is numeric.  Both null: no outcome.  A wrong value is a false positive and
    a false negative; so is a value on one side only, of its own kind.
    """
    return _outcomes(_side_by_side(found, gold, keys, fields), keys, fields)


def _side_by_side(found: DataFrame, gold: DataFrame, keys: Sequence[str], fields: Mapping[str, bool]) -> DataFrame:
    """(keys, p, g): full join by ``keys``; only the fields themselves are shuffled, and made ready where they have met."""
    raw = lambda df, x: df.select(*keys, *[F.col(f).alias(f"{x}_{i}") for i, f in enumerate(fields)])
    own = lambda df, x: _ready(df, fields, [F.col(f"{x}_{i}") for i in range(len(fields))]).alias(x)
    return raw(found, "_p").join(raw(gold, "_g"), list(keys), "full").select("*", own(found, "_p").alias("p"), own(gold, "_g").alias("g"))


def _outcomes(both: DataFrame, keys: Sequence[str], fields: Mapping[str, bool]) -> DataFrame:
    rows = []
    for name, numeric in fields.items():
        a, b = F.col(f"p.{name}"), F.col(f"g.{name}")
        rows.append(F.struct(F.lit(name).alias("field"), _same(a, b, numeric).alias("hit"), F.coalesce(a["has"], F.lit(False)).alias("has_p"), F.coalesce(b["has"], F.lit(False)).alias("has_g")))
    flat = both.select(*keys, F.inline(F.array(*rows)))
    one = lambda c: c.cast("long")
    return flat.select(
        *keys, "field", one(F.col("hit")).alias("tp"), one(F.col("has_p") & ~F.col("hit")).alias("fp"), one(F.col("has_g") & ~F.col("hit")).alias("fn"),
        one(F.col("has_p") | F.col("has_g")).alias("total"), one(F.col("hit")).alias("correct"),
    )


def field_comparison(found: DataFrame, gold: DataFrame, keys: Sequence[str], fields: Mapping[str, bool], verdicts: DataFrame | None = None) -> DataFrame:
    """(keys, field, found, gold, strict, judge): a row for each field of a pair of records that has a value on a side.

    ``strict`` says whether the values match.  ``judge`` is the verdict on those that do not, from (keys, field, verdict):
    YES only if it says so but for case and blanks, else NO; null for strict matches.
    """
    both = _side_by_side(found, gold, keys, fields)
    if verdicts is not None:  # dealt as the records are, a row for each pair
        yes = F.upper(F.trim("verdict")) == "YES"
        own = verdicts.groupBy(*keys).agg(*[F.max(F.when(F.col("field") == f, yes)).alias(f"_yes_{i}") for i, f in enumerate(fields)])
        both = both.join(own, list(keys), "left")
    rows = [
        F.struct(
            F.lit(f).alias("field"), F.col(f"_p_{i}").cast("string").alias("found"), F.col(f"_g_{i}").cast("string").alias("gold"),
            _same(F.col(f"p.{f}"), F.col(f"g.{f}"), numeric).alias("strict"), (F.lit(False) if verdicts is None else F.coalesce(f"_yes_{i}", F.lit(False))).alias("yes"),
        )
        for i, (f, numeric) in enumerate(fields.items())
    ]
    flat = both.select(*keys, F.inline(F.array(*rows))).where(F.col("found").isNotNull() | F.col("gold").isNotNull())
    return flat.select(*keys, "field", "found", "gold", "strict", F.when(~F.col("strict"), F.when(F.col("yes"), "YES").otherwise("NO")).alias("judge"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def precision_recall(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sums over each group with precision, recall and F1, each 0 on an empty denominator."""
    sums = outcomes.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = sums.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def field_accuracy(outcomes: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, total, correct, accuracy) of every named field; 1 where a field never had a value."""
    spark = outcomes.sparkSession
    names = spark.createDataFrame([(f,) for f in fields], "field string")
    sums = outcomes.groupBy("field").agg(F.sum("total").alias("total"), F.sum("correct").alias("correct"))
    return F.broadcast(names).join(sums, "field", "left").select(
        "field", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("correct", F.lit(0)).alias("correct"),
        F.coalesce(F.try_divide(F.col("correct").cast("double"), F.col("total")), F.lit(1.0)).alias("accuracy"),
    )


def similarities(found: DataFrame, gold: DataFrame, doc: str, pos: str, fields: Mapping[str, bool]) -> DataFrame:
    """(doc, found_pos, gold_pos, matches): every found record against every gold one of the same document.

    Null against null counts as a match.  A document's records are few; documents are dealt by key.
    """
    p = found.select(doc, F.col(pos).alias("found_pos"), _ready(found, fields).alias("p"))
    g = gold.select(doc, F.col(pos).alias("gold_pos"), _ready(gold, fields).alias("g"))
    hits = [(_same(F.col(f"p.{f}"), F.col(f"g.{f}"), numeric) | (~F.col(f"p.{f}.has") & ~F.col(f"g.{f}.has"))).cast("long") for f, numeric in fields.items()]
    return p.join(g, doc).select(doc, "found_pos", "gold_pos", sum(hits[1:], hits[0]).alias("matches"))


def align(found: DataFrame, gold: DataFrame, doc: str, pos: str, fields: Mapping[str, bool], rel: float = 1e-9) -> DataFrame:
    """(doc, found_pos, gold_pos, matches): the one-to-one pairing of each document with the most matching fields.

    Of pairings with equally many matching fields (null against null counts) one with the most fields that match by a value
    is taken, so that a document's true positives are the same in all of them.  Records without partner stand with null
    on the other side; so do all records without document.  Equal records are dealt in the order of their positions.
    The rows of a document meet in one task as classes of equal records, never as pairs.
    """
    return _aligned(_by_document(_sides(found, gold, doc, pos, fields)), len(fields), rel, False).withColumnRenamed("doc", doc)


def _sides(found: DataFrame, gold: DataFrame, doc: str, pos: str, fields: Mapping[str, bool]) -> DataFrame:
    """(doc, side, pos, n0, t0, n1, t1, ...): the records of both sides, with the number and the text of each field."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return _flat(df.select(F.col(doc).alias("doc"), F.lit(name).alias("side"), F.col(pos).alias("pos"), _ready(df, fields).alias("r")), fields)

    return side(found, "found").unionByName(side(gold, "gold"))


def _flat(rows: DataFrame, fields: Mapping[str, bool]) -> DataFrame:
    """The records ``r`` as columns; a value that is not there has neither number nor text."""
    own = [(F.col(f"r.{f}"), i) for i, f in enumerate(fields)]
    return rows.select("doc", "side", "pos", *[F.when(r["has"], r[c]).alias(f"{c}{i}") for r, i in own for c in "nt"])


def _by_document(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.col("doc"), F.when(F.col("doc").isNull(), F.xxhash64("pos")))


def _aligned(rows: DataFrame, width: int, rel: float, whole: bool) -> DataFrame:
    """(doc, found_pos, gold_pos, matches) of _sides(), dealt by document; with ``whole``, also the fields of both records (pn0, pt0, ..., gn0, ...)."""
    kinds = dict(rows.dtypes)
    rows = rows.sortWithinPartitions(*rows.columns)
    fields = [f"{c}{i}" for i in range(width) for c in "nt"]
    schema = f"doc {kinds['doc']}, found_pos {kinds['pos']}, gold_pos {kinds['pos']}, matches long"
    schema += "".join(f", {x}{c} {kinds[c]}" for x in "pg" for c in fields) if whole else ""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _documents(batches):
            codes, numbers = zip(*[_codes(block.column(f"n{i}"), block.column(f"t{i}")) for i in range(width)])
            doc = block.column("doc").dictionary_encode(null_encoding="encode").indices.to_numpy()
            stand = pc.or_(block.column("doc").is_null(), pc.equal(block.column("side"), "none")).to_numpy(zero_copy_only=False)
            is_found = pc.equal(block.column("side"), "found").to_numpy(zero_copy_only=False)
            a, b, matches = aligned_rows(doc, is_found, stand, np.stack(codes), np.stack(numbers), rel)
            for start in range(0, len(a), _ROWS):
                x, y = (pa.array(k[start : start + _ROWS], pa.int64(), mask=k[start : start + _ROWS] < 0) for k in (a, b))
                n = matches[start : start + _ROWS]
                columns = [block.column("doc").take(pc.coalesce(x, y)), block.column("pos").take(x), block.column("pos").take(y), pa.array(n, pa.int64(), mask=n < 0)]
                columns += [block.column(c).take(k) for k in (x, y) for c in fields] if whole else []
                yield pa.RecordBatch.from_arrays(columns, ["doc", "found_pos", "gold_pos", "matches", *([x + c for x in "pg" for c in fields] if whole else [])])

    return rows.mapInArrow(solve, schema)


_ROWS = 8192
#: Rows of whole documents that are paired at a time, where no document has more.
_BLOCK = 1 << 16


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document, in blocks that hold whole documents."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < _BLOCK:
            continue
        key = batch.column("doc").dictionary_encode(null_encoding="encode").indices.to_numpy()
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
        if not cut:
            same = len(held) > 1 and held[-2].column("doc")[-1] == batch.column("doc")[0]
            if same or len(held) == 1:
                continue  # one document still
        held[-1] = batch.slice(0, cut)
        yield _joined([h for h in held if h.num_rows])
        held, size = [batch.slice(cut)], batch.num_rows - cut
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _codes(n: pa.Array, t: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes, numbers) of a field's values: -1 for none, the same code for the same number or text; NaN for no number."""
    numbers = n.to_numpy(zero_copy_only=False).astype(float) + 0.0  # no -0.0
    has = n.is_valid().to_numpy(zero_copy_only=False)
    texts = pc.fill_null(t.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pa.array(numbers, mask=~has).dictionary_encode()
    return np.where(has, pc.fill_null(values.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + (texts.max(initial=-1) + 1), texts), np.where(has, numbers, np.nan)


def aligned_outcomes(found: DataFrame, gold: DataFrame, doc: str, pos: str, fields: Mapping[str, bool]) -> DataFrame:
    """pair_outcomes of the optimal pairing, of documents that have a name."""
    return _aligned_outcomes(_by_document(_sides(found, gold, doc, pos, fields)), doc, fields)


def _aligned_outcomes(sides: DataFrame, doc: str, fields: Mapping[str, bool]) -> DataFrame:
    pairs = _aligned(sides.where("doc is not null or side = 'none'"), len(fields), 1e-9, True)
    pair = F.concat_ws(":", F.coalesce(F.col("found_pos").cast("string"), F.lit("-")), F.coalesce(F.col("gold_pos").cast("string"), F.lit("-")))
    record = lambda x: F.struct(*[F.struct(F.col(f"{x}n{i}").alias("n"), F.col(f"{x}t{i}").alias("t"), (F.col(f"{x}n{i}").isNotNull() | F.col(f"{x}t{i}").isNotNull()).alias("has")).alias(f) for i, f in enumerate(fields)])
    return _outcomes(pairs.select(F.col("doc").alias(doc), pair.alias("pair"), record("p").alias("p"), record("g").alias("g")), [doc, "pair"], fields)


def document_metric(rows: DataFrame, by: str, found: str, gold: str, fields: Mapping[str, bool]) -> DataFrame:
    """(by, found JSON, gold JSON) -> (by, f1) of each row's records under ``experiments``, paired as align() does.

    A text that is no JSON object, has no list of records, or holds records that are no objects counts as having none,
    and a document without score has 0.  ``by`` names each row.
    """
    # a row of neither side keeps each document, so that the rows are made once
    texts = rows.select(F.col(by).alias("doc"), F.inline(F.array(*[F.struct(F.lit(side).alias("side"), text.alias("text")) for side, text in (("found", F.col(found)), ("gold", F.col(gold)), ("none", F.lit(None)))])))
    each = texts.select("doc", "side", F.posexplode_outer(F.try_variant_get(F.try_parse_json("text"), "$.experiments", "array<variant>")).alias("pos", "value"))
    each = each.where(is_kind(F.col("value"), "OBJECT") | (F.col("side") == "none"))
    records = each.select("doc", "side", "pos", *[F.try_variant_get("value", f"$['{f}']", "string").alias(f) for f in fields])
    records = _by_document(records)  # before normal forms are made, each of which names a value more than once
    sides = _flat(records.select("doc", "side", "pos", _ready(records, fields).alias("r")), fields)
    return precision_recall(_aligned_outcomes(sides, by, fields), [by]).select(by, "f1")


def macro_f1(scores: DataFrame, documents: DataFrame, doc: str) -> DataFrame:
    """Mean F1 over all documents; one that has no score counts as 0."""
    return documents.select(doc).distinct().join(scores, doc, "left").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.avg(F.coalesce("f1", F.lit(0.0))), F.lit(0.0)).alias("mean_f1"))
