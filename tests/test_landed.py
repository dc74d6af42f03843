"""Landed pages as a source, in a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathework.sources.landed import LandedPages


def land(folder, source, number, ids, data=None):
    (folder / source).mkdir(parents=True, exist_ok=True)
    body = "".join(f"<li><a href='/view?id={i}'>title {source} {i}</a></li>" for i in ids) + "<a href='/about'>about</a>"
    (folder / source / f"{number}.html").write_bytes(data or body.encode())


def rows(frame):
    return sorted((r.source, r.priority, r.page, r.id, r.note) for r in frame.withColumn("page", F.coalesce("page", F.lit(0))).withColumns({c: F.coalesce(c, F.lit("")) for c in ("id", "note")}).collect())


def test_batch(spark, tmp_path):
    spark.dataSource.register(LandedPages)
    for page in range(1, 20):
        land(tmp_path, "a", page, [page * 10, page * 10 + 1])
    land(tmp_path, "b", 1, [5, 5, 6])
    land(tmp_path, "b", 2, [], b"\xff\xfe broken")
    land(tmp_path, "b", 3, [7])
    land(tmp_path, "c", 1, [])
    read = lambda **o: spark.read.format("landed_pages").option("path", str(tmp_path)).option("links", r"id=(\d+)").options(**o).load()
    found = read(sources="a,b,c,none")
    assert found.rdd.getNumPartitions() == 6
    got = rows(found)
    assert [r for r in got if r[0] == "a"] == sorted(("a", 0, p, str(p * 10 + k), "") for p in range(1, 20) for k in (0, 1))
    assert [r[2:4] for r in got if r[0] == "b" and not r[4]] == [(1, "5"), (1, "6"), (3, "7")]
    assert [(r[2], r[4][:12]) for r in got if r[0] == "b" and r[4]] == [(2, "UnicodeDecod")]
    assert [r for r in got if r[0] in ("c", "none")] == [("c", 2, 0, "", "0 rows"), ("none", 3, 0, "", "0 rows")]
    assert [r[2:4] for r in rows(read(sources="a", most=3))] == [(1, "10"), (1, "11"), (2, "20")]
    assert {r[2] for r in rows(read(sources="a", pages=2))} == {1, 2}


def test_stream(spark, tmp_path):
    spark.dataSource.register(LandedPages)
    folder = tmp_path / "in"
    land(folder, "a", 1, [1, 2])

    def more():
        stream = spark.readStream.format("landed_pages").option("path", str(folder)).option("sources", "a,b").option("links", r"id=(\d+)").load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted((r.source, r.page, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = [("a", 1, "1"), ("a", 1, "2")]
    assert more() == first
    assert more() == first
    land(folder, "a", 2, [3])
    land(folder, "b", 1, [4])
    assert more() == [*first, ("a", 2, "3"), ("b", 1, "4")]
