"""JSON in the texts of models: spans between brackets, missing commas, canonical values; vectorised over Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: commas that a repair puts in at most.
REPAIRS = 7
_CLOSING = {"{": "}", "[": "]"}
#: Marks that matter between brackets: escapes, quotes and brackets.
_MARK = re.compile(r'\\.?|["{}\[\]]', re.DOTALL)
#: Tokens of JSON: strings, brackets and separators, and bare words and numbers.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+', re.DOTALL)


def spans(text: str, kind: str, begin: int = 0, quotes: bool = True) -> Iterator[tuple[int, int, bool]]:
    """(start, end, flat) of each bracket of a kind that closes, in the order of closing; flat: none of the kind inside.

    Brackets in quotes do not count, unless ``quotes`` is off.
    """
    open_at: list[int] = []
    last_open, quoted = -1, False
    for mark in _MARK.finditer(text, begin):
        sign = mark[0]
        if sign == '"':
            quoted = quotes and not quoted
        elif quoted:
            continue
        elif sign == kind:
            last_open = mark.start()
            open_at.append(last_open)
        elif sign == _CLOSING[kind] and open_at:
            start = open_at.pop()
            yield start, mark.end(), start == last_open


def first_value(text: str | None, kinds: str = "{") -> str | None:
    """From the first bracket of the kinds to where it closes; of an object that never closes, the first flat one."""
    starts = [(at, kind) for kind in kinds for at in [(text or "").find(kind)] if at >= 0]
    if not starts:
        return None
    begin, kind = min(starts)
    for start, end, _ in spans(text, kind, begin):
        if start == begin:
            return text[start:end]
    flat = min(((start, end) for start, end, flat in spans(text, "{", quotes=False) if flat), default=None) if "{" in kinds else None
    return text[slice(*flat)] if flat else None


def with_commas(text: str) -> str | None:
    """With a comma between two values that follow each other without one; null if more are missing than a repair puts in."""
    starts = lambda t: t[0] not in ",:}]"
    ends = lambda t: t[0] not in ",:{["
    gaps = [b.start() for a, b in pairwise(_TOKEN.finditer(text)) if ends(a[0]) and starts(b[0])]
    return None if len(gaps) > REPAIRS else "".join(text[a:b] + ("," if b in gaps else "") for a, b in pairwise([0, *gaps, len(text)]))


def loaded(text: str) -> str | None:
    """Canonical JSON of a text, or of the text with commas put in."""
    for attempt in (text, with_commas(text)):
        try:
            return None if attempt is None else json.dumps(json.loads(attempt), sort_keys=True, ensure_ascii=False)
        except (json.JSONDecodeError, RecursionError):
            continue
    return None


def value_of(text: str | None) -> str | None:
    """Canonical JSON of a model's text: of all of it, else of its first fenced block, else of what its outermost brackets hold."""
    if text is None:
        return None
    whole = loaded(text.strip())
    if whole is not None:
        return whole
    fences = text.split("```", 2)
    if len(fences) == 3:
        block = fences[1]
        return loaded((block[4:] if block[:4].lower() == "json" else block).strip())
    brackets = [m.start() for m in re.finditer(r"[{}\[\]]", text)]
    opening, closing = [i for i in brackets if text[i] in "{["], [i for i in brackets if text[i] in "}]"]
    return loaded(text[opening[0] : closing[-1] + 1]) if opening and closing and opening[0] < closing[-1] else None


def _first_objects(texts: pd.Series) -> pd.Series:
    return texts.map(first_value)


def _first_values(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: first_value(t, "{["))


def _values(texts: pd.Series) -> pd.Series:
    return texts.map(value_of)


def first_object(c: Column) -> Column:
    """The first balanced JSON object of a text, or its first flat one; null if there is none.  Texts without a bracket stay in the JVM."""
    return F.when(c.contains("{"), F.pandas_udf(_first_objects, "string")(c))


def first_array_or_object(c: Column) -> Column:
    """The first balanced JSON array or object of a text."""
    return F.when(c.rlike(r"[{\[]"), F.pandas_udf(_first_values, "string")(c))


def tolerant_json(c: Column) -> Column:
    """Canonical JSON of a model's text; null if nothing can be made of it.  Texts without a bracket stay in the JVM."""
    return F.when(c.rlike(r"[{\[]"), F.pandas_udf(_values, "string")(c))


def without_thoughts(c: Column) -> Column:
    """Without <think> blocks."""
    return F.regexp_replace(c, r"(?s)<think>.*?</think>", "")


def without_fences(c: Column) -> Column:
    """Without the lines that open and close Markdown fences."""
    return F.trim(F.regexp_replace(c, r"(?m)^\s*```[A-Za-z]*\s*$\n?", ""))
