"""Call protection: circuit breaker, rate limit, ring history, and event windows; in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Breaker:
    """Opens after ``failures`` failures in a row; after ``reset_s`` seconds admits ``probes`` calls, of which a success
    closes it and a failure opens it again.  Blocked calls do not count."""

    failures: int = 8
    reset_s: float = 30.0
    probes: int = 1

    def __post_init__(self) -> None:
        if self.failures < 1 or self.reset_s < 0 or self.probes < 1:
            raise ValueError("failures and probes must be 1 or more, reset_s 0 or more")

    def start(self) -> tuple[str, int, float, int]:
        """State, failures in a row, time of the last failure, probes under way."""
        return "closed", 0, 0.0, 0

    def step(self, state: tuple[str, int, float, int], at: float, ok: bool) -> tuple[tuple[str, int, float, int], bool, str]:
        """-> state after, whether the call went through, the state it met."""
        name, row, last, probes = state
        if name == "open" and at - last >= self.reset_s:
            name, probes = "half_open", 0
        met = name
        if name == "open" or (name == "half_open" and probes >= self.probes):
            return (name, row, last, probes), False, met
        if ok:
            return self.start(), True, met
        row += 1
        if name == "half_open" or row >= self.failures:
            return ("open", row, at, 0), True, met
        return (name, row, at, probes), True, met


def replayed(calls: DataFrame, breaker: Breaker) -> DataFrame:
    """(key, seq, at seconds, ok) -> (key, seq, met, admitted): each key's calls in order.

    Keys are dealt over tasks and sorted; a task holds one state at a time, however many calls a key has.
    """
    kinds = dict(calls.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, breaker.start()
        for batch in batches:
            met, admitted = [], []
            for key, at, ok in zip(batch["key"], batch["at"], batch["ok"]):
                if key != now:
                    now, state = key, breaker.start()
                state, through, name = breaker.step(state, at, ok)
                met.append(name)
                admitted.append(through)
            yield batch[["key", "seq"]].assign(met=met, admitted=admitted)

    ordered = calls.select("key", "seq", "at", "ok").repartition("key").sortWithinPartitions("key", "at", "seq")
    return ordered.mapInPandas(run, f"key {kinds['key']}, seq {kinds['seq']}, met string, admitted boolean")


def streamed_breaker(calls: DataFrame, breaker: Breaker) -> DataFrame:
    """The same on a stream, with the state of each key kept between batches; calls of a batch are taken in order."""
    kinds = dict(calls.dtypes)

    def run(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else breaker.start()
        rows = pd.concat(frames).sort_values(["at", "seq"])
        met, admitted = [], []
        for at, ok in zip(rows["at"], rows["ok"]):
            state, through, name = breaker.step(state, float(at), bool(ok))
            met.append(name)
            admitted.append(through)
        held.update(state)
        yield rows[["key", "seq"]].assign(met=met, admitted=admitted)

    out = f"key {kinds['key']}, seq {kinds['seq']}, met string, admitted boolean"
    return calls.groupBy("key").applyInPandasWithState(run, out, "state string, failures long, last double, probes long", "append", "NoTimeout")


def rate_limited(calls: DataFrame, delay: float) -> DataFrame:
    """(key, seq, at, duration) -> with ``start``: calls of a key in order, each ``delay`` after the end of the one before.

    start = base + the greatest of (at - base) so far, with base the durations and delays of all calls before.
    """
    w = Window.partitionBy("key").orderBy("at", "seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("duration").over(before), F.lit(0.0)) + (F.row_number().over(w) - 1) * F.lit(delay)
    c = calls.withColumn("base", base)
    return c.withColumn("start", F.col("base") + F.max(F.col("at") - F.col("base")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("base")


def last_calls(calls: DataFrame, n: int = 200) -> DataFrame:
    """The last n calls of each key."""
    w = Window.partitionBy("key").orderBy(F.desc("seq"))
    return calls.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def tumbling(events: DataFrame, width: str, late: str = "1 day") -> DataFrame:
    """(ts, event_type, value) -> counts and sums by window and type; on a stream, with a watermark.  (An extension.)"""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    out = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(user_id, ts) -> sessions that a silence of ``gap`` ends.  (An extension.)"""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
