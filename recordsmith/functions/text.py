"""Column expressions on text: normal forms, document keys, tolerant comparison, typed conversion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dashes that count as a hyphen (minus sign, en dash, em dash).
DASHES = "−–—"
#: Endings that the document-key normal forms drop.
KEY_ENDINGS = ("pdf", "txt", "doc")
STEM_ENDINGS = ("_parsed", "_processed", "_result")
EXTRACTION_ENDINGS = ("_result", "_extraction", "_extractions", "_ext")
#: Numbers that a conversion accepts; Spark's own cast also takes endings such as 10d.
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def stripped(c: Column) -> Column:
    """Without white space at the ends, of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normal_text(c: Column) -> Column:
    """For comparison: null as empty, dashes as hyphens, no white space; case stays."""
    return F.regexp_replace(F.translate(F.coalesce(c.cast("string"), F.lit("")), DASHES, "-" * len(DASHES)), r"(?U)\s+", "")


def canonical_ref(c: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def _ending(endings: Sequence[str], dot: bool = False) -> str:
    return ("\\." if dot else "") + "(" + "|".join(sorted(endings, key=len, reverse=True)) + ")$"


def document_key(c: Column) -> Column:
    """Of an id in a ground-truth table or a split: stripped, lower, one file ending off."""
    return F.regexp_replace(F.lower(stripped(c)), _ending(KEY_ENDINGS, dot=True), "")


def stem_key(c: Column) -> Column:
    """Of a document file's stem: lower, stripped, one processing mark off."""
    return F.regexp_replace(stripped(F.lower(c)), _ending(STEM_ENDINGS), "")


def extraction_key(c: Column) -> Column:
    """Of an extraction file's stem: one mark off, case mattering, then lower and stripped."""
    return stripped(F.lower(F.regexp_replace(c, _ending(EXTRACTION_ENDINGS), "")))


def split_key(c: Column) -> Column:
    """Of an id in a split under validation: one file ending off, wholly lower or wholly upper; then lower and stripped."""
    endings = [*KEY_ENDINGS, "json"]
    return stripped(F.lower(F.regexp_replace(c, _ending([*endings, *map(str.upper, endings)], dot=True), "")))


def number(c: Column) -> Column:
    """As a double, or null."""
    text = c.cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def is_close(a: Column, b: Column, rel: float = 1e-9) -> Column:
    """Equal but for a relative difference; not-a-number is close to nothing."""
    near = (a == b) | (F.abs(a - b) <= F.lit(rel) * F.greatest(F.abs(a), F.abs(b)))
    return F.coalesce(near & ~F.isnan(a) & ~F.isnan(b), F.lit(False))


def value_match(found: Column, gold: Column, numeric: bool) -> Column:
    """Whether a found value is the gold one: numbers where both are, else normal texts; null matches null only."""
    text = normal_text(found) == normal_text(gold)
    if numeric:
        text = F.when(number(found).isNotNull() & number(gold).isNotNull(), is_close(number(found), number(gold))).otherwise(text)
    return F.when(gold.isNull(), found.isNull()).when(found.isNull(), F.lit(False)).otherwise(text)


def first_filled(columns: Sequence[Column], default: Column | None = None) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns], F.lit(None) if default is None else default)


def as_type(c: Column, kind: str) -> Column:
    """A text as str, int, float or bool; null where it is none.  A float text is no int."""
    text = c.cast("string")
    if kind == "int":
        return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("long"))
    if kind == "float":
        return number(c)
    if kind == "bool":
        return F.lower(text).isin("true", "1", "yes")
    return text


def shortened(c: Column, limit: int = 180) -> Column:
    """With an ellipsis, if longer than the limit."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def truthy(c: Column) -> Column:
    """Whether a text says true; null does not."""
    return F.coalesce(F.lower(stripped(c.cast("string"))) == "true", F.lit(False))


def page_list(c: Column) -> Column:
    """Array of texts -> sorted distinct page numbers; what is no number, or none of 18 digits at most, goes."""
    numbers = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.when(x.rlike(r"^\d{1,18}$"), x.try_cast("long")))
    return F.array_sort(F.array_distinct(F.array_compact(numbers)))


def cell(c: Column) -> Column:
    """A table cell's text: white space runs as one blank, none at the ends, pipes escaped."""
    return F.replace(F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", " ")), F.lit("|"), F.lit("\\|"))


def column_title(name: Column, unit: Column) -> Column:
    return F.when(F.coalesce(cell(unit), F.lit("")) == "", cell(name)).otherwise(F.concat(cell(name), F.lit(" ("), cell(unit), F.lit(")")))


def panel_key(c: Column) -> Column:
    """Lower case, without the pairs of brackets around it, however many."""
    bare = F.lower(stripped(F.coalesce(c, F.lit(""))))
    inner = lambda x, _: F.when(x.startswith("(") & x.endswith(")") & (F.length(x) > 2), stripped(F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(x)
    return F.aggregate(F.sequence(F.lit(0), F.length(F.regexp_replace(bare, r"[^(]", ""))), bare, inner)


def digest12(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)


def digest8(c: Column) -> Column:
    return F.substring(F.md5(c), 1, 8)


#: Words that say that a figure is a supplementary one, and words for figure.
EXTRA_WORDS = ("supplementary", "supplemental", "supp")
FIGURE_WORDS = ("figure", "figures")


def figure_slug(c: Column) -> Column:
    """A figure's label as a name: fig_3 of Figure 3(b), supp_fig_s1 of Supplementary Figure S1; blank or null: empty.

    The label is read as words and signs.  A number right after the word for figure loses its panel letter, be it part of
    the number, bracketed or alone, unless the words before are extended data.  A full stop after a spelt-out word belongs to it.
    """
    one_of = lambda names: lambda w: F.coalesce(F.rtrim(w, F.lit(".")).isin(*names), F.lit(False))
    extra, figure = one_of(EXTRA_WORDS), one_of(FIGURE_WORDS)
    read = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+\.?|[^\p{L}\p{N}_\s]"), F.lit(0))
    near = lambda words, i, by: F.get(words, i - by)  # noqa: E731  (null outside)
    tidy = lambda words: F.filter(words, lambda w: ~extra(w))
    named = lambda words: F.transform(words, lambda w: F.when(figure(w), "fig").otherwise(w))

    def numbered(words: Column, i: Column, pattern: str) -> Column:
        """Whether a word is the number of a figure whose panels do not count."""
        extended = (near(words, i, 2) == "data") & (near(words, i, 3) == "extended")
        return F.coalesce(F.get(words, i).rlike(pattern) & (near(words, i, 1) == "fig") & ~F.coalesce(extended, F.lit(False)), F.lit(False))

    def part(words: Column, w: Column, i: Column) -> Column:
        whole = lambda by: numbered(words, i - by, "^s?[0-9]+$")
        letter = F.coalesce(w.rlike("^[a-z]\\.?$") & (whole(1) | (whole(2) & (near(words, i, 1) == "("))), F.lit(False))
        return F.when(letter, "").when(numbered(words, i, "^s?[0-9]+[a-z]\\.?$"), F.regexp_replace(w, "[a-z]\\.?$", "")).otherwise(w)

    each = lambda words: F.transform(words, lambda w, i: part(words, w, i))
    once = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  (so that a value is made once)
    parts = once(read, lambda r: once(tidy(r), lambda t: once(named(t), each)))
    slug = F.regexp_replace(F.regexp_replace(F.array_join(parts, " "), "[^a-z0-9]+", "_"), "^_|_$", "")
    return F.when(F.exists(read, extra) & slug.startswith("fig_"), F.concat(F.lit("supp_"), slug)).otherwise(slug)


def float_text(d: Column) -> Column:
    """The shortest text of a double: whole ones without a point (their digits up to 2**63), others with an exponent below 1e-4 only."""
    read = lambda g: F.regexp_extract(d.cast("string"), r"^(-?)(\d+)\.(\d+)(?:E(-?\d+))?$", g)
    power = F.coalesce(F.nullif(read(4), F.lit("")).cast("int"), F.lit(0))
    digits = F.concat(read(2), F.when(read(3) == "0", "").otherwise(read(3)))
    point = F.length(read(2)) + power  # digits before the point, counted from the first digit
    bare = F.ltrim(digits, F.lit("0"))
    lead = point - (F.length(digits) - F.length(bare))  # the same from the first one that is not zero
    small = F.concat(F.substring(bare, 1, 1), F.when(F.length(bare) > 1, F.concat(F.lit("."), F.substring(bare, F.lit(2), F.length(bare)))).otherwise(""), F.lit("e-"), F.lpad((1 - lead).cast("string"), 2, "0"))
    zeros = F.concat(F.lit("0."), F.repeat(F.lit("0"), -lead), bare)
    plain = F.concat(F.substring(bare, F.lit(1), lead), F.lit("."), F.substring(bare, lead + 1, F.length(bare)))
    whole = F.when(F.abs(d) < 2.0**63, d.try_cast("long").cast("string")).otherwise(d.try_cast("decimal(38,0)").cast("string"))
    text = F.when(lead <= -4, small).when(lead <= 0, zeros).otherwise(plain)
    return F.when(d.isNull() | F.isnan(d), F.when(F.isnan(d), "nan")).when(F.abs(d) == float("inf"), F.when(d > 0, "inf").otherwise("-inf")).when(d % 1 == 0, whole).otherwise(F.concat(read(1), text))


def scalar_text(c: Column) -> Column:
    """Text of a JSON scalar: strings without quotes, true and false, whole floats without a point and others as short as can be; null for null."""
    text = F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), "v string")["v"]
    return (
        F.when(c.rlike(r"^(null|\s*)$"), None).when(c.rlike(r"^-?\d+$") | c.isin("true", "false"), c)
        .when(c.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), float_text(c.try_cast("double"))).otherwise(text)
    )
