"""Caches as state of a stream: what is held for a key, until when, and what becomes of it.

Rejections, resolved addresses and what was seen are held for some days, told by each row, so that a jitter by the key's hash
(as in `dates.expiry`) or a deadline may be in them. Time is that of the events: an entry goes when the watermark has passed
it. The state is a value state of one row a key and a timer; sessions that use it need the RocksDB state store (`STORE`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The setting that a session needs before such a stream begins.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
DAY = 86_400_000_000


class _Cache(StatefulProcessor):
    """(value, at, until) of a key; a timer at `until`."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "value string, at bigint, until bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, Spark's name
        held = self.held.get() if self.held.exists() else None
        began, told = held, []
        for piece in rows:
            piece = piece.sort_values(["at", "value"], na_position="first")
            for at, value, days, out in zip(piece["at"].tolist(), piece["value"].tolist(), piece["days"].tolist(), piece["out"].tolist(), strict=True):
                value = None if pd.isna(value) else value
                if held is not None and at < held[1]:
                    continue  # older than what is held
                if held is not None and at >= held[2]:
                    told.append(("expired", held[0], held[2]))
                    held = None
                if out:
                    if held is not None:
                        told.append(("discarded", held[0], at))
                    held = None
                elif held is None or held[0] != value:
                    told.append(("recorded" if held is None else "changed", value, at))
                    held = (value, at, at + int(days * DAY))
        if held != began:
            if began is not None:
                self.handle.deleteTimer(-(-began[2] // 1000))
            if held is None:
                self.held.clear()
            else:
                self.held.update(held)
                self.handle.registerTimer(-(-held[2] // 1000))
        if told:
            change, value, at = zip(*told, strict=True)
            yield pd.DataFrame({"key": [key[0]] * len(told), "change": change, "value": value, "at": at})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, Spark's name
        if not self.held.exists():
            return
        value, _, until = self.held.get()
        self.held.clear()
        yield pd.DataFrame({"key": [key[0]], "change": ["expired"], "value": [value], "at": [until]})

    def close(self) -> None:
        pass


def changes(stream: DataFrame, key: str, at: str, value: Column, days: Column, out: Column | None = None, late: str = "1 day") -> DataFrame:
    """(key, change, value, at): what rows of a stream, by time, do to a cache of strings.

    `recorded`: the key was not held; `changed`: it was, with another value; both hold it for `days` from then on. The same
    value again changes nothing and does not prolong the time. `discarded`: `out` holds for a row, and the key was held.
    `expired`: its time had passed, told with that time, by the watermark or by a later row, whichever comes first. Rows
    without key, time or days, and rows older than what is held, are dropped. A null value is one like any other.
    Rows of a trigger come in pieces, each by time; of equal times the smallest value comes first.
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull() & days.isNotNull()).withWatermark(at, late)
    gone = F.coalesce(out, F.lit(False)) if out is not None else F.lit(False)
    rows = rows.select(F.col(key).alias("key"), F.col(at).alias("_at"), F.unix_micros(F.col(at)).alias("at"), value.cast("string").alias("value"), days.cast("double").alias("days"), gone.alias("out"))
    told = rows.groupBy("key").transformWithStateInPandas(_Cache(), f"key {kind}, change string, value string, at bigint", "Append", "EventTime")
    return told.select(F.col("key").alias(key), "change", "value", F.timestamp_micros("at").alias(at))
