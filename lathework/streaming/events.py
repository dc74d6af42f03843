"""The same operators over streams: late rows are tolerated within a watermark, state is bounded by time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lathework.sinks import tables


def read_tables(spark: SparkSession, path: str, schema, files: int = 10) -> DataFrame:
    """A stream of the Parquet files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def first_seen(stream: DataFrame, key: list[str], at: str, late: str = "7 days") -> DataFrame:
    """Each key once; a repeat within `late` of the first is dropped, and older keys leave the state."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def sent_again_after(stream: DataFrame, key: str, at: str, days: int, late: str = "7 days") -> DataFrame:
    """(key, at) of what is new: a key's first row, and its first row `days` or more after the last that was new.

    A key is new at most once a trigger. Its state is one time, and goes when the watermark has passed it by `days`. Rows
    without key or time are dropped. Rows of a trigger pass in pieces, so a key with very many of them takes no more room.
    """
    keep = days * 86_400_000_000

    def fresh(name: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        found = None
        for piece in pieces:
            times = piece["micros"] if last is None else piece["micros"][piece["micros"] >= last + keep]
            if len(times) and (found is None or times.min() < found):
                found = int(times.min())
        if found is not None:
            last = found
            state.update((last,))
            yield pd.DataFrame({"key": [name[0]], "micros": [found]})
        state.setTimeoutTimestamp(max((last + keep) // 1000, state.getCurrentWatermarkMs() + 1))

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.withWatermark(at, late).where(F.col(key).isNotNull() & F.col(at).isNotNull())
    rows = rows.select(F.col(key).alias("key"), at, F.unix_micros(at).alias("micros"))
    told = rows.groupBy("key").applyInPandasWithState(fresh, f"key {kind}, micros bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)
    return told.select(F.col("key").alias(key), F.timestamp_micros("micros").alias(at))


def windowed_counts(stream: DataFrame, by: list[str], at: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    counted = stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *by, "n")


def deliver_then_commit(stream: DataFrame, deliver: Callable[[DataFrame], DataFrame], history: str, key: str, checkpoint: str):
    """Delivers what the history lacks, then appends the keys that `deliver` says have arrived: at least once, never lost.

    `deliver` takes the new rows and returns those delivered. A batch that fails in between is delivered again.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = spark.read.schema(batch.select(key).schema).parquet(history) if tables.exists(spark, history) else batch.select(key).limit(0)
        fresh = batch.join(held, key, "left_anti")
        deliver(fresh.dropDuplicates([key])).select(key).write.mode("append").parquet(history)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True)
