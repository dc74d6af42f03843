"""Numbers, running sums and greedy choices over links, against plain loops."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from lathework.operators import sequence


def test_numbers_and_sums(spark):
    rows = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("v"), F.when(F.col("id") % 3 != 0, F.col("id") % 11).alias("w"))
    got = sequence.running_sum(sequence.numbered(rows, [F.col("v").desc()]), [F.col("v").desc()], F.col("w")).orderBy("number").collect()
    assert [(r.number, r.v) for r in got] == [(i, 999 - i) for i in range(1000)]
    total = 0
    for r in got:
        total += r.w or 0
        assert r.sum == total
    assert sequence.numbered(rows.limit(0), [F.col("v")]).collect() == []
    assert sequence.running_sum(rows.limit(0), [F.col("v")], F.col("w")).collect() == []


def plain_stays(links):
    before = {}
    for a, b in links:
        before.setdefault(a, set())
        before.setdefault(b, set()).add(a)
    stays = {}
    for b in sorted(before):
        stays[b] = not any(stays[a] for a in before[b])
    return stays


def shapes():
    r = random.Random(3)
    chain = [(i, i + 1) for i in range(200)]
    band = [(i, i + k) for i in range(1000, 1080) for k in (1, 2, 3)]
    star = [(2000, 2000 + k) for k in range(1, 60)] + [(2100 + k, 2200) for k in range(60)]
    loose = [tuple(sorted(r.sample(range(3000, 3200), 2))) for _ in range(260)]
    return chain + band + star + loose


@pytest.mark.parametrize("segment", [None, 60])
def test_first_come(spark, segment):
    links = shapes() + shapes()[:40]
    frame = spark.createDataFrame(links, "a bigint, b bigint").repartition(5)
    got = {r.id: r.stays for r in sequence.first_come(frame, "a", "b", segment).collect()}
    assert got == plain_stays(links)
    assert sequence.first_come(frame.limit(0), "a", "b").collect() == []


def test_long_chain(spark):
    """A chain of 10000 rows takes few rounds, and no task gets more than a segment's links."""
    frame = spark.range(9999).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    began = time.monotonic()
    rows = sequence.first_come(frame, "a", "b", 2000).collect()
    assert {r.id for r in rows if r.stays} == set(range(0, 10000, 2))
    assert len(rows) == 10000
    assert time.monotonic() - began < 60


def plain_slots(links):
    dead, near = {}, {}
    for a, b, a_dead, b_dead, ratio in links:
        dead[a], dead[b] = a_dead, b_dead
        near[a, b] = ratio
    held = []
    for row in sorted(dead):
        best = max((h for h in held if (h[1], row) in near), key=lambda h: near[h[1], row], default=None)
        if best is None:
            held.append([row, row])
        elif dead[best[1]] and not dead[row]:
            best[1] = row
    slot = {row: s for s, row in held}
    return {r: slot.get(r, -1) for r in dead}


@pytest.mark.parametrize("segment", [None, 60])
def test_folded(spark, segment):
    r = random.Random(8)
    dead = {i: r.random() < 0.4 for i in range(4000)}
    links = [(a, b, dead[a], dead[b], r.choice([0.9, 0.92, 0.95, 1.0])) for a, b in sorted(set(shapes()))]
    frame = spark.createDataFrame(links, "a bigint, b bigint, a_dead boolean, b_dead boolean, ratio double").repartition(5)
    assert {r.id: r.slot for r in sequence.folded(frame, segment).collect()} == plain_slots(links)


def test_many_links_settle_at_once(spark, monkeypatch):
    """Where links are many to a row, rounds over all rows leave none, so that none goes by segments."""
    r = random.Random(4)
    links = sorted({tuple(sorted(r.sample(range(400), 2))) for _ in range(8000)})
    frame = spark.createDataFrame(links, "a bigint, b bigint").repartition(5)
    monkeypatch.setattr(sequence, "settle", None)
    got = {x.id: x.stays for x in sequence.first_come(frame, "a", "b", 60).collect()}
    assert got == plain_stays(links)
