"""Entries that live for a fixed time from when they were stored: what a cache would have made of a run of accesses, on streams and tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What becomes of an access, or of an entry.
OUTCOMES = "outcome string, at timestamp, stored timestamp"
#: The state store that keyed state with timers needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MICROS = 1_000_000


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[us]").astype("int64")


def _times(micros: list[int]) -> pd.Series:
    return pd.Series(np.array(micros, "int64").astype("datetime64[us]"))


def outcomes(times: np.ndarray, stored: int | None, life: int) -> tuple[list[tuple[str, int, int]], int | None]:
    """(outcome, time, stored) of one key's accesses in order, and when the entry that is left was stored.

    An access within *life* of the entry's storing is a hit; any other a miss, which stores the entry anew and evicts the one before
    at the end of its life.  A hit does not lengthen a life.
    """
    out = []
    for at in times.tolist():
        if stored is not None and at < stored + life:
            out.append(("hit", at, stored))
            continue
        if stored is not None:
            out.append(("evicted", stored + life, stored))
        stored = at
        out.append(("miss", at, at))
    return out, stored


class _Entries(StatefulProcessor):
    """The state of a key is when its entry was stored; a timer at the end of its life evicts it."""

    def __init__(self, key: str, seconds: float) -> None:
        self.key, self.life = key, int(seconds * _MICROS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "stored long")

    def _rows(self, key, found: list[tuple[str, int, int]]) -> pd.DataFrame:
        names, at, stored = zip(*found, strict=True)
        return pd.DataFrame({self.key: [key] * len(found), "outcome": list(names), "at": _times(at), "stored": _times(stored)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = np.sort(np.concatenate([_micros(frame["ts"]) for frame in rows]))
        before = self.entry.get()[0] if self.entry.exists() else None
        found, stored = outcomes(times, before, self.life)
        if stored != before:
            if before is not None:
                self.handle.deleteTimer(-(-(before + self.life) // 1000))
            self.entry.update((stored,))
            self.handle.registerTimer(-(-(stored + self.life) // 1000))
        yield self._rows(key[0], found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        stored = self.entry.get()[0]
        self.entry.clear()
        yield self._rows(key[0], [("evicted", stored + self.life, stored)])

    def close(self) -> None:
        pass


def of_stream(events: DataFrame, key: str, seconds: float, late: str = "10 minutes") -> DataFrame:
    """*key*, ``outcome`` (hit, miss, evicted), ``at`` and ``stored`` for a stream of events with a time ``ts``.

    State is one number a key, gone when its entry is evicted by the watermark; accesses of a batch are taken in the order of their times.
    The session's state store must be PROVIDER.
    """
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).select(key, "ts").withWatermark("ts", late)
    schema = f"{key} {dict(events.dtypes)[key]}, {OUTCOMES}"
    return marked.groupBy(key).transformWithStateInPandas(_Entries(key, seconds), schema, "Append", "EventTime")


def of_table(events: DataFrame, key: str, seconds: float) -> DataFrame:
    """The same for a table, as of its newest event: entries whose life has ended by then are evicted.

    Accesses are sorted by key and time, and each partition is gone through once with one number in hand; rows without a key or
    time are left out.
    """
    life = int(seconds * _MICROS)
    kind = dict(events.dtypes)[key]
    rows = events.select(key, F.col("ts").cast("timestamp").alias("ts")).where(F.col(key).isNotNull() & F.col("ts").isNotNull())
    newest = rows.agg(F.max("ts")).first()[0]
    if newest is None:
        return events.sparkSession.createDataFrame([], f"{key} {kind}, {OUTCOMES}")
    end = rows.agg(F.max(F.unix_micros("ts"))).first()[0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, stored = None, None

        def made(name, found: list[tuple[str, int, int]]) -> pd.DataFrame:
            names, at, kept = zip(*found, strict=True)
            return pd.DataFrame({key: [name] * len(found), "outcome": list(names), "at": _times(at), "stored": _times(kept)})

        def left() -> Iterator[pd.DataFrame]:
            if stored is not None and stored + life <= end:
                yield made(now, [("evicted", stored + life, stored)])

        for frame in frames:
            for name, part in frame.groupby(key, sort=False):
                if name != now:
                    yield from left()
                    now, stored = name, None
                found, stored = outcomes(_micros(part["ts"]), stored, life)
                yield made(name, found)
        yield from left()

    return rows.repartition(key).sortWithinPartitions(key, "ts").mapInPandas(run, f"{key} {kind}, {OUTCOMES}")


def rates(found: DataFrame, key: str) -> DataFrame:
    """``hits``, ``misses`` and ``evictions`` by *key*."""
    count = lambda name: F.count_if(F.col("outcome") == name)
    return found.groupBy(key).agg(count("hit").alias("hits"), count("miss").alias("misses"), count("evicted").alias("evictions"))
