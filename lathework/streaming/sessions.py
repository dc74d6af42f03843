"""Conversations and sessions of events, alike for tables and streams, and two passes over one watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lathework.sinks import tables


def conversation(thread: Column, user: Column, channel: Column) -> Column:
    """The name of the conversation that a message belongs to: its thread's within its channel, or else its user's.

    Names are hashes of their parts, so that whoever meets a conversation first gives it the same name. Without thread and
    user there is none.
    """
    part = lambda kind, *of: F.sha2(F.to_json(F.struct(F.lit(kind).alias("kind"), *[c.cast("string").alias(f"c{i}") for i, c in enumerate(of)])), 256)
    return F.when(thread.isNotNull(), part("thread", F.coalesce(channel.cast("string"), F.lit("")), thread)).when(user.isNotNull(), part("user", user))


def opened(messages: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """`messages` with `is_new`: whether a message is its conversation's first. Conversations have no end.

    A conversation's first message is found by partial aggregation, so that one with very many is no single task's. Messages
    without a conversation are not new.
    """
    place = lambda: F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    firsts = messages.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("_name")).agg(F.min(place()).alias("_first"))
    return messages.join(firsts, F.col(name) == F.col("_name"), "left").withColumn("is_new", F.coalesce(F.col("_first") == place(), F.lit(False))).drop("_name", "_first")


def sessions(rows: DataFrame, by: list[str], at: str, gap: str, late: str | None = None, **measures: Column) -> DataFrame:
    """(by..., start, end, n, measures): events of one key with no more than `gap` between neighbours; `end` is the last one's time.

    Rows without a time are dropped. In a stream, `late` is how long a session waits for rows; then it is told, once.
    """
    rows = rows.where(F.col(at).isNotNull())
    rows = rows.withWatermark(at, late) if late else rows
    found = rows.groupBy(*by, F.session_window(at, gap).alias("_w")).agg(F.max(at).alias("end"), F.count("*").alias("n"), *[c.alias(k) for k, c in measures.items()])
    return found.select(*by, F.col("_w.start").alias("start"), "end", "n", *measures)


def watermark(spark: SparkSession, ledger: str, kind: str = "timestamp"):
    """The time up to which both passes are done; None before the first batch."""
    if not tables.versions(spark, f"{ledger}/watermark"):
        return None
    return tables.read(spark, f"{ledger}/watermark", f"batch bigint, at {kind}").agg(F.max("at")).first()[0]


def in_two_passes(stream: DataFrame, first: Callable[[DataFrame], DataFrame], second: Callable[[DataFrame], DataFrame], at: str, ledger: str, checkpoint: str) -> StreamingQuery:
    """Runs `first` over each batch and `second` over what it leaves, and moves one watermark when both are done.

    Each pass takes rows and returns rows, which are written to a folder of the pass and the batch's number; `second` reads
    those that `first` has written. A batch that is taken up again finds the folders of passes that were done and leaves
    these alone, so nothing is written twice. The watermark is the greatest `at` of all batches that are done; it never
    goes back, and an empty batch leaves it. Returns the query, which has begun; it ends when the input does.
    """
    ledger = ledger.rstrip("/")

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        left, out = f"{ledger}/first/batch={number}", f"{ledger}/second/batch={number}"
        if not tables.exists(spark, f"{left}/_SUCCESS"):
            first(batch).write.mode("overwrite").parquet(left)
        if not tables.exists(spark, f"{out}/_SUCCESS"):
            second(spark.read.parquet(left)).write.mode("overwrite").parquet(out)
        kind = batch.schema[at].dataType.simpleString()
        held = tables.read(spark, f"{ledger}/watermark", f"batch bigint, at {kind}")
        if held.where(F.col("batch") >= number).isEmpty():
            told = batch.agg(F.lit(number).cast("bigint").alias("batch"), F.max(at).alias("at")).unionByName(held)
            tables.write(told.agg(F.max("batch").alias("batch"), F.max("at").alias("at")).coalesce(1), f"{ledger}/watermark")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written(spark: SparkSession, ledger: str, which: str, schema: str) -> DataFrame:
    """What a pass, first or second, has written in all batches, with the batch's number."""
    return spark.read.schema(f"{schema}, batch bigint").parquet(f"{ledger.rstrip('/')}/{which}")
