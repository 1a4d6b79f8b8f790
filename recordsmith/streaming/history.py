"""The last calls of each key as a stream with arbitrary state: a value for the ring, a timer for keys that fall silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State of this kind needs a store with column families.
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RING = "key string, seq long, age long, version long, closed boolean"


class Ring(StatefulProcessor):
    """Keeps the n calls of a key with the greatest seq; a call that repeats a seq in the ring replaces it.

    Each batch with calls of a key gives its ring anew, under the next version.  When the watermark is ``idle_ms`` past a
    key's last call, its ring is given once more as closed, and its state goes.
    """

    def __init__(self, n: int, idle_ms: int):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value, as every call to the store costs a key more than its work does
        self.ring = handle.getValueState("ring", "seqs array<long>, version long, last long")

    def _rows(self, key: tuple, seqs: list[int], version: int, closed: bool) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]] * len(seqs), "seq": seqs, "age": range(1, len(seqs) + 1), "version": version, "closed": closed})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.ring.get()
        seqs, version, last = (set(held[0]), *held[1:]) if held else (set(), 0, 0)
        for frame in rows:  # never more than n and one batch
            seqs = set(sorted(seqs | set(frame["seq"].tolist()), reverse=True)[: self.n])
            last = max(last, int(frame["ms"].max()))
        newest, version = sorted(seqs, reverse=True), version + 1
        self.ring.update((newest, version, last))
        if not held:  # a key's only timer; it is set anew when it expires, if there were calls since
            self.handle.registerTimer(last + self.idle_ms)
        yield self._rows(key, newest, version, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        newest, version, last = self.ring.get()
        if last + self.idle_ms > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(last + self.idle_ms)
            return
        self.ring.clear()
        yield self._rows(key, list(newest), version + 1, True)

    def close(self) -> None:
        pass


def streamed_ring(calls: DataFrame, n: int = 200, idle_ms: int = 86_400_000, late: str = "1 day") -> DataFrame:
    """(key, seq, at) stream -> (key, seq, age, version, closed): the last n calls of each key that had calls in a batch.

    ``age`` counts from 1 for the newest.  Rows without key, seq or time are left out; so are calls that come later than ``late`` after their time.  The session must use a store for state
    with column families; see store_for().
    """
    at = F.col("at").cast("timestamp")
    rows = calls.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), at.alias("at"), F.unix_millis(at).alias("ms"))
    rows = rows.where("key is not null and seq is not null and at is not null").withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(Ring(n, idle_ms), RING, "Update", "EventTime")


def store_for(spark: SparkSession) -> None:
    """Use the store that streamed_ring() needs."""
    spark.conf.set(STORE, ROCKS)


def current_rings(versions: DataFrame) -> DataFrame:
    """All rows that streamed_ring() ever gave -> (key, seq, age) of each key's latest ring that is not closed."""
    last = versions.groupBy("key").agg(F.max("version").alias("version"))
    return versions.join(last, ["key", "version"]).where("not closed").select("key", "seq", "age")
