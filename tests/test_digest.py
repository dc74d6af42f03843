"""The digest on a small table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lathework.plans import digest as d


def item(o, title, outlet="o", gid=None, url=None, hours=1, region="kr"):
    return o, gid or f"g{o}", title, outlet, region, url, None, dt.datetime(2031, 3, 10, 12) - dt.timedelta(hours=hours), [f"t{o}"]


def test_digest(spark):
    now = F.lit("2031-03-10 12:00:00").cast("timestamp")
    start = F.lit("2031-03-08 12:00:00").cast("timestamp")
    rows = [
        item(1, "AI 건설 가온 착공"), item(2, "AI 건설 가온 착공", "p"), item(3, "AI 건설 가온 착공", "o", gid="g3"), item(4, "AI 도면 나래", url="https://a.example/x?utm_source=f"), item(5, "AI 도면 나래 검토", url="http://www.a.example/x/"),
        item(6, "AI 건설 옛 소식", hours=100), item(7, "AI 데이터센터 건설"), item(8, "빵 굽기"), item(9, "AI 건설 보낸 기사", gid="sent"), item(10, "AI 건설 거절된 기사", gid="bad"), item(11, "AI BIM 이미 알림"), item(12, "AI 건설 다음"), item(13, "x"),
    ]
    history = spark.createDataFrame([("gid:sent", None)], d.HISTORY)
    rejected = spark.createDataFrame([("bad", dt.datetime(2031, 3, 11)), ("g12", dt.datetime(2031, 3, 9))], d.REJECTED)
    recent = spark.createDataFrame([("aibim이미알림", None)], d.RECENT)
    got = d.digest(spark.createDataFrame(rows, d.ITEM).repartition(3), history, rejected, recent, now, start, stories_most=2)
    assert {r.ord: (r.story, r.themes) for r in got.main.collect()} == {4: (4, ["t4"]), 1: (1, ["t1", "t3"]), 2: (1, ["t2"])}
    assert [r.ord for r in got.infra.collect()] == [7]
    assert got.infra_over.collect() == []
    assert [r.ord for r in got.later.collect()] == [12]
    assert [r.ord for r in got.rejected.collect()] == [8]
    assert {r.key for r in d.history_changes(got.main.where("ord = 4"), now).collect()} == {"gid:g4", "title:o|ai도면나래", "url:a.example/x"}
    assert d.recent_changes(got.main, now).count() == 2
