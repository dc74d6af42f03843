"""Keyed tables in buckets: what a batch touches is written, versions stay whole, and the rest is as a plain dict has it."""

from __future__ import annotations

import random

from lathework.sinks import buckets

SCHEMA = "key string, n bigint, v string"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def held(spark, path, version=None):
    return {r.key: (r.n, r.v) for r in buckets.read(spark, path, SCHEMA, version).collect()}


def test_against_a_dict(spark, tmp_path):
    path, r = str(tmp_path / "t"), random.Random(2)
    want, all_versions = {}, []
    assert held(spark, path) == {}
    for step in range(4):
        batch = [(f"k{r.randrange(60)}", 10 * step + i % 3, f"{step}.{i}") for i in range(25)]
        batch = list({(k, n): (k, n, v) for k, n, v in batch}.values())
        for k, n, v in batch:
            if k not in want or n > want[k][0]:
                want[k] = (n, v)
        done = buckets.upsert(rows(spark, batch), path, SCHEMA, ["key"], ["n"], 8)
        assert done.version == step + 1
        assert held(spark, path) == want
        all_versions.append(dict(want))
    assert [held(spark, path, n + 1) for n in range(4)] == all_versions


def test_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.upsert(rows(spark, [(f"k{i}", 1, "a") for i in range(500)]), path, SCHEMA, ["key"], ["n"], 16)
    done = buckets.upsert(rows(spark, [("k3", 2, "b"), (None, 2, "c"), ("k5", None, "d"), ("new", 1, "e")]), path, SCHEMA, ["key"], ["n"])
    assert done.buckets <= 2
    assert sorted(r.v for r in done.failed.collect()) == ["c", "d"]
    assert len(list((tmp_path / "t/data/v=2").glob("_bucket=*"))) == done.buckets
    size = lambda v: sum(f.stat().st_size for f in (tmp_path / f"t/data/v={v}").rglob("*.parquet"))
    assert size(2) < size(1) / 4
    assert len(held(spark, path)) == 501
    assert held(spark, path)["k3"] == (2, "b")
    none = buckets.upsert(rows(spark, [(None, 1, "x")]), path, SCHEMA, ["key"], ["n"])
    assert (none.version, none.buckets, none.failed.count()) == (2, 0, 1)
    found = buckets.lookup(spark, path, SCHEMA, ["key"], rows(spark, [("k3", 0, ""), ("no", 0, ""), ("k3", 1, ""), (None, 0, "")]))
    assert [(r.key, r.v) for r in found.collect()] == [("k3", "b")]


def test_a_lost_writer_leaves_nothing_that_counts(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.upsert(rows(spark, [("a", 1, "x")]), path, SCHEMA, ["key"], ["n"], 4)
    rows(spark, [("a", 9, "half")]).write.parquet(f"{path}/data/v=2/_bucket=0")  # no manifest was written
    assert held(spark, path) == {"a": (1, "x")}
    buckets.upsert(rows(spark, [("b", 1, "y")]), path, SCHEMA, ["key"], ["n"])
    assert held(spark, path) == {"a": (1, "x"), "b": (1, "y")}


def test_delete_rebucket_forget(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.upsert(rows(spark, [(f"k{i}", 1, "a") for i in range(40)]), path, SCHEMA, ["key"], ["n"], 8)
    done = buckets.delete(rows(spark, [("k1", 0, ""), ("k2", 0, ""), ("none", 0, ""), (None, 0, "")]), path, SCHEMA, ["key"])
    assert [r.key for r in done.failed.collect()] == ["none"]
    want = {f"k{i}": (1, "a") for i in range(40) if i not in (1, 2)}
    assert held(spark, path) == want
    assert buckets.rebucket(spark, path, SCHEMA, ["key"], 3) == 3
    assert held(spark, path) == want
    buckets.upsert(rows(spark, [("k3", 2, "b")]), path, SCHEMA, ["key"], ["n"])
    assert buckets.forget(spark, path, 2) == [1, 2]
    assert held(spark, path, 3) == want
    assert held(spark, path) == want | {"k3": (2, "b")}
    assert not list((tmp_path / "t/data/v=1").glob("_bucket=*"))
