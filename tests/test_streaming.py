"""Streams give what the batch operators give."""

from __future__ import annotations

import json
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from lathework.streaming import events


def test_windows_and_first_seen(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = events.read_tables(spark, str(tmp_path / "in"), rows.schema).withColumn("at", F.col("ts").cast("timestamp"))
    first = events.first_seen(stream, ["user_id"], "at", "60 days")
    q = first.writeStream.format("memory").queryName("first_seen").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("first_seen").count() == rows.select("user_id").distinct().count()


def test_delivery_is_committed_by_key(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "key bigint, v string")
    rows.write.parquet(str(tmp_path / "in"))
    seen, history = [], str(tmp_path / "history")

    def deliver(batch):
        keys = sorted(r.key for r in batch.collect())
        seen.append(keys)
        return batch.where("key < 3") if len(seen) == 1 else batch

    for n in range(2):
        stream = events.read_tables(spark, str(tmp_path / "in"), rows.schema)
        events.deliver_then_commit(stream, deliver, history, "key", str(tmp_path / f"c{n}")).start().awaitTermination(120)
    assert seen == [[1, 2, 3], [3]]
    assert sorted(r.key for r in spark.read.parquet(history).collect()) == [1, 2, 3]


def test_keys_are_new_again_after_their_time(spark, tmp_path):
    day = lambda n: datetime(2024, 1, 1, tzinfo=UTC) + timedelta(days=n)
    batches = [[("a", 0), ("a", 3), ("b", 1), (None, 2)], [("a", 30), ("b", 60), ("c", 5), ("c", 5)], [("a", 45), ("b", 90), ("a", 120)], [("b", 106), ("c", 49)]]
    for rows in batches:
        spark.createDataFrame([(k, day(n)) for k, n in rows], "key string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.read_tables(spark, str(tmp_path / "in"), "key string, at timestamp", 1)
    out = events.sent_again_after(stream, "key", "at", 45, "400 days")
    out.writeStream.format("memory").queryName("again").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(200)
    days = F.datediff("at", F.lit("2024-01-01"))
    got = sorted((r.key, r.n) for r in spark.table("again").select("key", days.alias("n")).collect())
    assert got == [("a", 0), ("a", 45), ("b", 1), ("b", 60), ("b", 106), ("c", 5)]


def test_state_goes_with_the_watermark(spark, tmp_path):
    day = lambda n: datetime(2024, 1, 1, tzinfo=UTC) + timedelta(days=n)
    for rows in [[("a", 0)], [("b", 200)], [("b", 201)], [("a", 210)]]:
        spark.createDataFrame([(k, day(n)) for k, n in rows], "key string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.read_tables(spark, str(tmp_path / "in"), "key string, at timestamp", 1)
    out = events.sent_again_after(stream, "key", "at", 45, "10 days")
    q = out.writeStream.format("memory").queryName("gone").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    days = F.datediff("at", F.lit("2024-01-01"))
    assert sorted((r.key, r.n) for r in spark.table("gone").select("key", days.alias("n")).collect()) == [("a", 0), ("a", 210), ("b", 200)]
    assert sum(p["stateOperators"][0]["numRowsRemoved"] for p in map(lambda p: json.loads(p.json), q.recentProgress) if p["stateOperators"]) >= 1
