"""Model calls as functions of batches: pluggable, with a deterministic offline stub, and never for rows that need none."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_text import value_of
from ..functions.text import normal_text
from .lineage import settled

#: (task texts) -> answers; runs in the tasks, so it must be importable or a closure.
Backend = Callable[[list[str]], list[str]]


def offline(prompts: list[str]) -> list[str]:
    """A judge without a model: YES where both lines of the prompt agree but for white space and case."""
    out = []
    for prompt in prompts:
        found, _, gold = prompt.partition("\n")
        out.append("YES" if "".join(found.split()).lower() == "".join(gold.split()).lower() else "NO")
    return out


def called(rows: DataFrame, prompt: str, answer: str, backend: Backend = offline) -> DataFrame:
    """With the backend's answer for each row; a failed batch is called again row by row, a failed row answers null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prompts = batch[prompt].fillna("").tolist()
            try:
                answers = backend(prompts)
            except Exception:  # noqa: BLE001
                answers = [_one(backend, p) for p in prompts]
            yield batch.assign(**{answer: answers})

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(run, f"{fields}, `{answer}` string")


def _one(backend: Backend, prompt: str) -> str | None:
    try:
        return backend([prompt])[0]
    except Exception:  # noqa: BLE001
        return None


def judged(pairs: DataFrame, backend: Backend = offline) -> DataFrame:
    """(found, gold, …) -> with ``same``: strict equality first; the judge sees only pairs of texts that differ."""
    strict = F.coalesce(normal_text(F.col("found")) == normal_text(F.col("gold")), F.lit(False))
    one_sided = F.col("found").isNull() | F.col("gold").isNull()
    open_ = pairs.where(~strict & ~one_sided).withColumn("_prompt", F.concat_ws("\n", "found", "gold"))
    answered = called(open_, "_prompt", "_answer", backend).withColumn("same", F.coalesce(F.upper(F.trim("_answer")) == "YES", F.lit(False))).drop("_prompt", "_answer")
    settled = pairs.where(strict | one_sided).withColumn("same", strict | (F.col("found").isNull() & F.col("gold").isNull()))
    return settled.unionByName(answered)


def incremental(wanted: DataFrame, done: DataFrame, key: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What is done, and the work on what is not."""
    return done.join(wanted.select(key), key, "left_semi").unionByName(work(wanted.join(done, key, "left_anti")))


#: What an error's text says if the call may be made again.
RETRYABLE = ("disconnected", "connection", "timeout", "network", "503", "504")


def retryable(error: Column) -> Column:
    """Whether an error's text says that the call may be made again; null does not."""
    return F.coalesce(F.lower(error).rlike("|".join(RETRYABLE)), F.lit(False))


#: (prompts, budget of output tokens) -> (answer, reason why it is not finished, or null) for each; runs in the tasks.
Generator = Callable[[list[str], int | None], list[tuple[str, str | None]]]
#: What the trail says of an attempt: not finished, no JSON, and an answer after others.
UNFINISHED, UNREAD, RECOVERED = "model_json_generation_retry:{}:finish_reason={}", "model_json_parse_retry:{}:{}", "model_json_recovered_after_retry:{}"


def _json_problem(text: str) -> str:
    try:
        json.loads(text.strip())
    except json.JSONDecodeError as error:
        return error.msg
    return "no JSON value"


def parsed_answers(rows: DataFrame, prompt: str, generator: Generator, budget: int | None = None, retries: int = 2) -> DataFrame:
    """(..., prompt) -> (..., raw, parsed, attempts, warnings, status): answers as canonical JSON, asked for again where there is none.

    Each round asks for the rows that are still open, with twice the budget of the round before, and is kept before the
    next one, so that no row is asked again once it has an answer.  An answer that is not finished, or that holds no JSON,
    leaves its row open and a line in ``warnings``.  After 1 + retries rounds open rows have the status ``failed``, their
    last raw answer and no parsed one; the others ``ok``.  A null prompt is asked as an empty text.  No rows: no rounds.
    """
    open_ = rows.withColumns({"raw": F.lit(None).cast("string"), "parsed": F.lit(None).cast("string"), "warnings": F.array().cast("array<string>")})
    ended = []
    for attempt in range(1, 2 + max(0, retries)):

        def run(batches: Iterator[pd.DataFrame], attempt: int = attempt, now: int | None = budget) -> Iterator[pd.DataFrame]:
            for batch in batches:
                raw, parsed, warnings = [], [], []
                for (text, unfinished), before in zip(generator(batch[prompt].fillna("").tolist(), now), batch["warnings"]):
                    value = None if unfinished is not None else value_of(text)
                    note = UNFINISHED.format(attempt, unfinished) if unfinished is not None else UNREAD.format(attempt, _json_problem(text)) if value is None else RECOVERED.format(attempt) if attempt > 1 else None
                    raw.append(text)
                    parsed.append(value)
                    warnings.append([*before, *([note] if note else [])])
                yield batch.assign(raw=raw, parsed=parsed, warnings=warnings)

        asked = settled(open_.mapInPandas(run, open_.schema)).withColumn("attempts", F.lit(attempt))
        ended.append(asked.where("parsed is not null").withColumn("status", F.lit("ok")))
        open_ = asked.where("parsed is null").drop("attempts")
        budget = budget * 2 if budget and budget > 0 else budget
        if open_.isEmpty():
            break
    ended.append(open_.withColumn("attempts", F.lit(attempt)).withColumn("status", F.lit("failed")))
    return reduce(DataFrame.unionByName, ended).select(*rows.columns, "raw", "parsed", "attempts", "warnings", "status")


def batch_extraction(requested: DataFrame, documents: DataFrame, key: str, generator: Generator, budget: int | None = None, retries: int = 0) -> DataFrame:
    """(key) and (key, text) -> (key, parsed, attempts, warnings, status): an answer for each requested document.

    ``missing``: there is no such document, and no call for it; ``failed``: no answer could be read; else ``ok``.  A key that is
    requested more than once is asked once; of several texts under one key the least is taken.
    """
    texts = documents.groupBy(key).agg(F.min("text").alias("_text"))
    wanted = requested.select(key).distinct().join(texts, key, "left")
    asked = parsed_answers(wanted.where("_text is not null"), "_text", generator, budget, retries).select(key, "parsed", "attempts", "warnings", "status")
    none = wanted.where("_text is null").select(key, F.lit(None).cast("string").alias("parsed"), F.lit(0).alias("attempts"), F.array().cast("array<string>").alias("warnings"), F.lit("missing").alias("status"))
    return asked.unionByName(none)


def batch_counters(done: DataFrame) -> DataFrame:
    """One row (total, success, failed) of a batch extraction."""
    return done.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ok").alias("success"), F.count_if(F.col("status") != "ok").alias("failed"))
