"""Whole plans and sinks on small tables."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from lathework.operators import scoring
from lathework.plans import announcements as a
from lathework.plans import retrieval
from lathework.sinks import render, tables

def day():
    return F.lit("2031-03-10").cast("date")


def at(text):
    return text and dt.datetime.fromisoformat(text + "T23:59:59")


def row(ord_, title, source="nipa", deadline="2031-04-01", posted="2031-03-01", department=None):
    return ord_, str(ord_), source, title, None, department, at(deadline), at(posted)


def test_monitor(spark):
    rows = [
        row(1, "가온 데이터 실증 지원사업 모집 공고"), row(2, "가온 데이터 실증 지원사업", "bizinfo"), row(3, "나래 AI 바우처", deadline="2031-03-01"),
        row(4, "[부산] 다솜 AI 바우처"), row(5, "라온 클라우드 보급"), row(6, "마루 소프트웨어 융합 과제", "bizinfo"), row(7, "바른 빵 굽기"), row(8, "사랑 인공지능 학교", posted="2031-03-05"),
        row(9, "차오름 디지털 뉴딜", posted="2031-02-01", deadline=None), row(10, "하늘 플랫폼 사업", deadline=None, posted="2031-02-20"),
    ]
    index = [("nipa_10", "하늘 플랫폼 사업", at("2031-03-12"), 5, 0.9), ("old_1", "마루 소프트웨어융합 과제 모집", at("2031-03-16"), 9, 0.8), ("old_2", "지난 과제", at("2031-03-01"), 3, 0.9), ("old_3", "미달 과제", at("2031-03-12"), 9, 0.1)]
    seen = [("nipa_5", "라온클라우드보급", 0.1, at("2031-03-20"))]
    out = a.monitor(spark.createDataFrame(rows, a.ANNOUNCEMENT), spark.createDataFrame(index, a.INDEX), spark.createDataFrame(seen, a.SEEN), day(), lambda t: t.withColumn("score", F.when(F.col("ord") == 1, 0.9).when(F.col("ord") == 8, 0.2)), most=2)
    assert {r.key: r.part for r in out.judged.collect()} == {"nipa_8": "below", "nipa_1": "new"}
    assert [r.key for r in out.deferred.collect()] == ["nipa_9"]
    assert {r.key: r.days for r in out.reminders.collect()} == {"nipa_10": 2, "old_1": 6}
    assert {r.reason: r.n for r in out.reasons.collect()} == {"region": 1, "over": 0, "unwanted": 0, "mildly_unwanted": 0, "no_keyword": 1}
    assert [(r.key, r.d_day) for r in a.index_changes(out.new, day()).collect()] == [("nipa_1", 22)]
    assert [(r.key, str(r.until)) for r in a.seen_changes(out.judged, day()).collect()] == [("nipa_8", "2031-04-01 00:00:00")]
    empty = a.monitor(spark.createDataFrame([], a.ANNOUNCEMENT), spark.createDataFrame([], a.INDEX), spark.createDataFrame([], a.SEEN), day())
    assert empty.new.collect() == empty.reminders.collect() == empty.deferred.collect() == []


def stub(batch):
    """Scores by the title; passes over one row, and fails on a batch with another."""
    if batch["title"].str.contains("나래").any():
        raise ValueError("overloaded")
    batch = batch[~batch["title"].str.contains("라온")]
    return pd.DataFrame({"no": batch["no"], "score": [0.9 if "AI" in t else 0.1 for t in batch["title"]]})


def test_monitor_with_a_judge_of_batches(spark):
    rows = [row(1, "가온 AI 실증 지원사업"), row(2, "나래 AI 바우처"), row(3, "다솜 소프트웨어 융합"), row(4, "라온 클라우드 보급"), row(5, "마루 AI 학교")]
    index, seen = spark.createDataFrame([], a.INDEX), spark.createDataFrame([], a.SEEN)
    for fallback, parts in ((None, "unscored"), (F.lit(0.7), "new")):
        score = scoring.scorer(stub, "key", [F.col("ord")], 1, fallback)
        out = a.monitor(spark.createDataFrame(rows, a.ANNOUNCEMENT), index, seen, day(), score)
        got = {r.ord: (r.part, r.judged, r.note) for r in out.judged.collect()}
        failed = (parts, fallback is not None and "fallback" or None, "ValueError: overloaded")
        assert got == {1: ("new", "first", None), 2: failed, 3: ("below", "first", None), 4: ("unscored", None, None), 5: ("new", "first", None)}
        # What a judge did not answer is no rejection: it is asked again in the next run.
        assert {r.key for r in a.seen_changes(out.judged, day()).collect()} == {"nipa_3"}


def test_retrieval(spark):
    rows = spark.createDataFrame([(i, "nipa" if i < 2 else "bizinfo", [1.0, float(i)], at("2031-03-11") if i % 2 else None) for i in range(8)], "id int, source string, v array<float>, deadline timestamp_ntz")
    found = retrieval.retrieve(rows, rows.where("id IN (0, 7)"), "id", "v", 5, retrieval.predicate("니파 공고"))
    assert {(r.query_id, r.rank): r.id for r in found.collect()} == {(0, n): n for n in range(1, 6)} | {(7, n): 7 - n for n in range(1, 6)}
    got = retrieval.due_soon(found.where("query_id = 7"), rows, "id", "deadline", day()).orderBy("place").collect()
    assert [r.id for r in got] == [6, 5, 3, 4, 2]
    assert retrieval.predicate("다른 질문") is None


def test_tables(spark, tmp_path):
    path, schema = f"file://{tmp_path}/t", "k string, v int, n int"
    make = lambda *r: spark.createDataFrame(list(r), schema)
    assert tables.read(spark, path, schema).collect() == []
    assert tables.upsert(make(("a", 1, 1), ("b", 1, 1), ("a", 2, 2)), path, schema, ["k"], ["n"]) == 1
    assert tables.upsert(make(("a", 3, 3), ("c", 1, 1)), path, schema, ["k"], ["n"]) == 2
    (tmp_path / "t" / "v=9").mkdir()
    assert sorted(tuple(r) for r in tables.read(spark, path, schema).collect()) == [("a", 3, 3), ("b", 1, 1), ("c", 1, 1)]
    shot = spark.createDataFrame([("s", 1), ("z", 2)], "source string, id int")
    tables.save_snapshot(shot, f"{tmp_path}/snap", "2031-01-01")
    tables.save_snapshot(shot.where("source = 's'").withColumn("id", F.lit(7)), f"{tmp_path}/snap", "2031-01-02")
    assert sorted((r.source, r.id) for r in tables.latest_snapshots(spark, f"{tmp_path}/snap", "id int").collect()) == [("s", 7), ("z", 2)]
    judged = spark.createDataFrame([("p", 0.9, None), ("r", 0.1, None), ("x", 0.9, at("2031-01-01")), ("f", None, None)], "key string, score double, deadline timestamp_ntz")
    assert [tuple(r) for r in tables.cache_changes(judged, 0.6, day()).orderBy("key").collect()] == [("p", "discard", 0.9), ("r", "record", 0.1), ("x", "record", 0.0)]
    aged = spark.createDataFrame([("2031-03-01",), ("2031-01-01",), (None,)], "t string").select(F.to_timestamp("t").alias("t"))
    assert tables.pruned(aged, "t", day().cast("timestamp"), tables.KEPT_DAYS["sent"]).count() == 1


def test_render(spark):
    blocks = [("g", i, i % 4 == 0, f"{'H' if i % 4 == 0 else 'i'}{i}") for i in range(11)]
    got = render.messages(spark.createDataFrame(blocks, "g string, o int, h boolean, t string"), "g", "o", "h", "t", most_blocks=4).orderBy("message").collect()
    assert [r.text.split("\n") for r in got] == [["H0", "i1", "i2", "i3"], ["H4", "i5", "i6", "i7"], ["H8", "i9", "i10"]]
    got = render.messages(spark.createDataFrame(blocks, "g string, o int, h boolean, t string"), "g", "o", "h", "t", most_blocks=5).orderBy("message").collect()
    assert [r.text.split("\n")[-1] for r in got] == ["i3", "i7", "i10"]
    one = spark.createDataFrame([("a<b|c", "https://x/?a|b", ["p", "q", "r", "s"], "One. Two. Three.")], "l string, u string, p array<string>, t string")
    r = one.select(render.link(F.col("u"), F.col("l")), render.people(F.col("p")), render.first_sentences(F.col("t")), render.html_rows(F.col("l"), F.col("u"), F.lit(None).cast("string"))).first()
    assert tuple(r) == ("<https://x/?a%7Cb|a&lt;b|c>", "p, q, r +1", "One. Two.", '<li><a href="https://x/?a|b">a&lt;b|c</a> </li>')
    named = spark.createDataFrame([("a", 1, "Alpha"), ("b", 0, "Beta"), ("c", 2, "Gamma")], "source string, priority int, name string")
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), ("d",)], "source string")
    assert render.source_counts(rows, "source", named).first().text == "Gamma, Beta, Alpha and 1 more"
    assert [r.range for r in render.page_titles(rows.withColumn("g", F.lit(1)), ["g"], [F.col("source")], 2).orderBy("page", "source").collect()] == ["1~2/5", "1~2/5", "3~4/5", "3~4/5", "5~5/5"]
