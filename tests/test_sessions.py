"""Sessions and conversations, in tables and streams; two passes that move one watermark."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lathework.streaming import events, sessions

SCHEMA = "id bigint, user string, at timestamp"


def at(minutes):
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


def landed(spark, path, *batches):
    for rows in batches:
        spark.createDataFrame([(i, u, None if m is None else at(m)) for i, u, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_sessions_in_tables_and_streams(spark, tmp_path):
    rows = [(1, "a", 0), (2, "a", 9), (3, "a", 19), (4, "b", 3), (5, "a", 40), (10, "c", 0), (11, "c", 15), (6, "a", None), (7, "b", 3)]
    landed(spark, str(tmp_path / "in"), rows, [(8, "z", 5000)], [(9, "z", 9000)])
    table = spark.read.parquet(str(tmp_path / "in")).where("user <> 'z'")
    told = lambda d: sorted((r.user, r.start, r.end, r.n) for r in d.collect())
    want = [("a", at(0), at(19), 3), ("a", at(40), at(40), 1), ("b", at(3), at(3), 2), ("c", at(0), at(15), 2)]
    assert told(sessions.sessions(table, ["user"], "at", "15 minutes")) == want
    stream = events.read_tables(spark, str(tmp_path / "in"), SCHEMA, 1)
    out = sessions.sessions(stream, ["user"], "at", "15 minutes", "1 hour")
    out.writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(200)
    assert told(spark.table("told").where("user <> 'z'")) == want


def test_conversations(spark):
    rows = spark.createDataFrame([(1, "c", "t", "a"), (2, "c", "t", "b"), (3, "d", "t", "b"), (4, None, None, "a"), (5, "c", None, "a"), (6, None, None, None), (7, "c", "t", "a"), (7, "c", "t", "a")], "n int, channel string, thread string, user string")
    named = rows.withColumn("name", sessions.conversation(F.col("thread"), F.col("user"), F.col("channel")))
    got = sessions.opened(named, "name", [F.col("n")]).collect()
    assert sorted((r.n, r.is_new) for r in got) == [(1, True), (2, False), (3, True), (4, True), (5, False), (6, False), (7, False), (7, False)]
    assert len({r.name for r in got}) == 4


def test_two_passes(spark, tmp_path):
    landed(spark, str(tmp_path / "in"), [(1, "a", 5), (2, "junk", 7)], [(3, "b", 3), (4, "junk", 4)])
    ledger, ran = str(tmp_path / "ledger"), {"first": 0, "second": 0}

    def clean(rows):
        ran["first"] += 1
        return rows.where("user <> 'junk'")

    def digest(rows):
        ran["second"] += 1
        if ran["second"] == 1:
            raise ValueError("not now")
        return rows.groupBy("user").agg(F.count("*").alias("n"))

    def go():
        stream = events.read_tables(spark, str(tmp_path / "in"), SCHEMA, 1)
        sessions.in_two_passes(stream, clean, digest, "at", ledger, str(tmp_path / "c")).awaitTermination(200)

    with pytest.raises(Exception, match="not now"):
        go()
    assert sessions.watermark(spark, ledger) is None
    assert sessions.written(spark, ledger, "first", SCHEMA).count() == 1
    go()
    # The first batch's cleanup was not done again; the second batch is older, and the watermark does not go back.
    assert ran == {"first": 2, "second": 3}
    assert sessions.watermark(spark, ledger) == at(7)
    assert sorted((r.user, r.n, r.batch) for r in sessions.written(spark, ledger, "second", "user string, n bigint").collect()) == [("a", 1, 0), ("b", 1, 1)]
    go()
    assert ran == {"first": 2, "second": 3}
