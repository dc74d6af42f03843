"""Circuits, held against a plain loop, with segments of a few calls."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lathework.operators import breaker


def plain(fails, limit, pause):
    """Outcomes of the calls of one source."""
    out, streak, left, trial = [], 0, 0, False
    opened = False
    for bad in fails:
        if opened and (pause is None or left > 0):
            left -= 1
            out.append("skipped")
            continue
        trial = opened
        out.append("failed" if bad else "ok")
        streak = streak + 1 if bad else 0
        opened = bad and (trial or streak >= limit)
        if opened:
            left = pause or 0
    return out


@pytest.mark.parametrize(("limit", "pause", "segment"), [(3, 2, 7), (1, 1, 5), (2, None, 4), (3, 4, None)])
def test_states(spark, limit, pause, segment):
    r = random.Random(limit)
    made = [(s, i, None if x < 0.1 else x < 0.5) for s, n in (("a", 60), ("b", 9), (None, 12), ("c", 1)) for i, x in ((i, r.random()) for i in range(n))]
    rows = spark.createDataFrame(r.sample(made, len(made)), "source string, n int, bad boolean")
    got = breaker.with_states(rows, "source", [F.col("n")], F.col("bad"), limit, pause, segment).collect()
    assert len(got) == len(made)
    for source in ("a", "b", "c", None):
        fails = [bad is not False for s, _, bad in made if s == source]
        assert [x.outcome for x in sorted((x for x in got if x.source == source), key=lambda x: x.n)] == plain(fails, limit, pause)


def test_none_and_wrong(spark):
    rows = spark.createDataFrame([], "source bigint, n int, bad boolean")
    assert breaker.with_states(rows, "source", [F.col("n")], F.col("bad")).count() == 0
    with pytest.raises(ValueError):
        breaker.with_states(rows, "source", [F.col("n")], F.col("bad"), 0)


def test_health(spark):
    rows = spark.createDataFrame([("a", "ok", 10, 8), ("a", "failed", 20, 20), ("b", "skipped", 0, 0), ("b", "failed", 0, 0), ("c", "ok", 9, 9), ("c", "ok", 10, 7)], "s string, outcome string, raw int, stale int")
    got = {r.s: tuple(r)[1:] for r in breaker.health(rows, ["s"], F.col("raw"), F.col("stale")).collect()}
    assert got == {"a": (2, 1, 0, False, False, 1), "b": (2, 2, 1, False, True, 0), "c": (2, 0, 0, True, False, 0)}


def test_unavailable(spark):
    runs = {"head": [1, 1, 1, 0, 0, 0, 0, 0], "half": [0, 1, 1, 1, 0, 0], "few": [1, 1], "less": [0, 1, 1, 1, 0, 0, 0], None: [1, 1, 1]}
    rows = spark.createDataFrame([(k, i, bool(x)) for k, v in runs.items() for i, x in enumerate(v)], "run string, n int, bad boolean")
    got = {r.run: r.unavailable for r in breaker.unavailable(rows, ["run"], [F.col("n")], F.col("bad")).collect()}
    assert got == {"head": True, "half": True, "few": False, "less": False, None: True}
