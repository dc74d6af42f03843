"""A cache in a stream, held against a plain loop over the same rows; the watermark takes out what has expired."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lathework.streaming import caches, events


@pytest.fixture
def store(spark):
    for k, v in caches.STORE.items():
        spark.conf.set(k, v)
    yield
    for k in caches.STORE:
        spark.conf.unset(k)


def day(n):
    return datetime(2024, 1, 1, tzinfo=UTC) + timedelta(days=n)


def plain(batches):
    """Changes by rows alone: (key, change, value, day)."""
    held, out = {}, []
    for rows in batches:
        for k, n, v, days, gone in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[2] or "")):
            had = held.get(k)
            if had and n < had[1]:
                continue
            if had and n >= had[2]:
                out.append((k, "expired", had[0], had[2]))
                del held[k]
                had = None
            if gone:
                if had:
                    out.append((k, "discarded", had[0], n))
                    del held[k]
            elif not had or had[0] != v:
                out.append((k, "changed" if had else "recorded", v, n))
                held[k] = (v, n, n + days)
    return out, held


def test_changes(spark, tmp_path, store):
    batches = [
        [("a", 0, "x", 10, False), ("a", 3, "x", 10, False), ("b", 1, None, 5, False), (None, 2, "x", 5, False), ("c", None, "x", 5, False), ("d", 2, "p", 90, False)],
        [("a", 9, "y", 10, False), ("b", 2, None, 5, False), ("d", 4, "p", 90, True), ("e", 4, "q", 5, True)],
        [("a", 8, "late", 10, False), ("a", 18, "y", 10, False), ("d", 9, "r", 90, False)],
        [("a", 19, "y", 10, False), ("f", 60, "z", 5, False)],
        [("f", 61, "z", 5, False)],
    ]
    path = str(tmp_path / "in")
    for rows in batches:
        made = [(k, None if n is None else day(n), v, d, g) for k, n, v, d, g in rows]
        spark.createDataFrame(made, "key string, at timestamp, v string, days int, gone boolean").coalesce(1).write.mode("append").parquet(path)
    stream = events.read_tables(spark, path, "key string, at timestamp, v string, days int, gone boolean", 1)
    told = caches.changes(stream, "key", "at", F.col("v"), F.col("days"), F.col("gone"), "30 days")
    told.writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(240)
    got = sorted((r.key, r.change, r.value or "", r.n) for r in spark.table("changes").select("key", "change", "value", F.datediff("at", F.lit("2024-01-01")).alias("n")).collect())
    by_rows, held = plain(batches)
    # By the end the watermark is 30 days before day 61, and takes out what was held until then or less.
    by_time = [(k, "expired", v, until) for k, (v, _, until) in held.items() if until <= 31]
    assert by_time and len(by_time) < len(held)
    assert got == sorted((k, c, v or "", n) for k, c, v, n in by_rows + by_time)
