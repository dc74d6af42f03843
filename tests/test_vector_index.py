"""The index finds what a comparison with all rows finds: nearly all by its nearest lists, all if it has to be exact."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathework.operators import vector_index as vi


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    # A third of all rows lies about one centre.
    which = np.where(rng.random(900) < 0.33, 0, rng.integers(0, 12, 900))
    data = centres[which] + rng.normal(size=(900, 16)) * 0.6
    made = [(i, [float(x) for x in v], int(w), f"text {i}") for i, (v, w) in enumerate(zip(data, which, strict=True))]
    made[10] = (10, made[9][1], made[9][2], "copy")
    made += [(1000, None, 0, "none"), (1001, [0.0] * 16, 0, "zero"), (1002, [float("nan")] * 16, 0, "nan"), (1003, [None] * 16, 0, "nulls")]
    table = spark.createDataFrame(made, "id bigint, v array<double>, kind int, text string")
    return vi.with_roles(table, "id", "v", ["kind"]).cache()


def brute(rows, ids, k, keep=lambda r: True):
    good = [r for r in rows.collect() if r.id < 1000]
    unit = {r.id: np.array(r.v) / np.linalg.norm(r.v) for r in good}
    out = set()
    for q in ids:
        near = sorted((-float(unit[q] @ unit[r.id]).__round__(9), r.id) for r in good if r.id != q and keep(r))
        out |= {(q, i) for _, i in near[:k]}
    return out


def pairs(found):
    return {(r.query_id, r.id) for r in found.collect()}


def test_recall_and_exact(spark, rows, monkeypatch):
    monkeypatch.setattr(vi, "PART", 50)  # the long list is parted
    index = vi.build(rows, 30)
    assert index.lists.count() == rows.count()
    assert index.lists.where("list = -1").count() == 4
    assert index.centres.agg(F.max("parts")).first()[0] > 1
    asked = rows.where("id % 10 = 0 OR id >= 1000")
    want = brute(rows, range(0, 900, 10), 5)
    got = pairs(vi.search(index, asked, 5, probes=8))
    assert len(got & want) >= 0.9 * len(want)
    assert pairs(vi.search(index, asked, 5, probes=1, exact=True)) == want
    near = vi.search(index, asked, 5, probes=8)
    truth = spark.createDataFrame(sorted(want), "query_id bigint, id bigint")
    assert vi.recall(near, truth) == pytest.approx(len(got & want) / len(want))


def test_predicates_by_role(rows):
    index = vi.build(rows, 30)
    where = vi.predicate(rows.schema, kind=[1, 2])
    asked = rows.where("id % 50 = 0 AND id < 900")
    want = brute(rows, range(0, 900, 50), 4, lambda r: r.kind in (1, 2))
    assert pairs(vi.search(index, asked, 4, probes=2, exact=True, where=where)) == want
    with pytest.raises(ValueError, match="text is not filterable"):
        vi.predicate(rows.schema, text="x")
    assert vi.by_role(index.payload.schema, "other") == ["text"] and "text" not in index.lists.columns


def test_saved_and_loaded(spark, rows, tmp_path):
    index = vi.build(rows, 20)
    vi.save(index, str(tmp_path / "index"))
    again = vi.load(spark, str(tmp_path / "index"))
    asked = rows.where("id = 9")
    where = vi.predicate(again.lists.schema, kind=rows.where("id = 9").first().kind)
    found = vi.search(again, asked, 3, exact=True, where=where, payload=True)
    first = found.orderBy("rank").first()
    assert (first.id, first.text, round(first.similarity, 9)) == (10, "copy", 1.0)


def test_empty(rows):
    index = vi.build(rows.limit(0))
    assert vi.search(index, rows, 3, exact=True).count() == 0
    assert vi.recall(vi.search(index, rows, 3), rows.limit(0).select(F.col("id").alias("query_id"), "id")) == 1.0


def test_probes_are_measured(spark, rows):
    index = vi.build(rows, 30)
    asked = rows.where("id % 10 = 0")
    probes = vi.probes_for(index, asked, 5, 0.95)
    truth = vi.search(index, asked, 5, exact=True)
    assert vi.recall(vi.search(index, asked, 5, probes), truth) >= 0.95
    assert probes == 1 or vi.recall(vi.search(index, asked, 5, probes // 2), truth) < 0.95
    assert vi.probes_for(vi.build(rows.limit(0)), rows, 5) == 1


def test_blocks_and_copies(spark, rows, monkeypatch):
    """Small blocks, shares of queries and more copies of a vector than are asked for: the first ids of equal ones are found."""
    monkeypatch.setattr(vi, "PART", 40)
    monkeypatch.setattr(vi, "QUERIES", 7)
    monkeypatch.setattr(vi, "CELLS", 100)
    copied = rows.where("id = 3").select((F.explode(F.sequence(F.lit(2000), F.lit(2059)))).alias("id"), "v", "kind", "text")
    table = vi.with_roles(rows.select("id", "v", "kind", "text").unionByName(copied.select(F.col("id").cast("long"), "v", "kind", "text")), "id", "v", ["kind"])
    asked = table.where("id % 10 = 3 AND id < 900 OR id = 2059")
    found = vi.search(vi.build(table, 9), asked, 5, probes=1, exact=True)
    got = pairs(found)
    assert {i for q, i in got if q == 3} == {2000, 2001, 2002, 2003, 2004}
    assert {i for q, i in got if q == 2059} == {3, 2000, 2001, 2002, 2003}
    plain = brute(rows, [q for q in range(13, 900, 10)], 5)
    alone = {q for q, i in plain} - {q for q, i in plain if i == 3}
    assert {p for p in got if p[0] in alone} == {p for p in plain if p[0] in alone}
