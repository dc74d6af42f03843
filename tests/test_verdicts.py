"""Verdicts by words and places."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lathework.operators import verdicts as v

CASES = [
    # title, category, department, reason, detail, overridden
    ("데이터 실증 사업", None, "부산광역시", "region", "부산광역시", False),
    ("데이터 실증 사업", None, "서울특별시", None, "데이터", False),
    ("[공고][부산] 데이터 실증", None, None, "region", "부산", False),
    ("[가온] 부산물 데이터 활용", None, None, None, "데이터", False),
    ("경상북도 주민 AI 서비스", "입찰공고", None, None, "AI", False),
    ("경기 광주시 창업 지원", None, None, None, "창업", False),
    ("광주 창업 지원", None, None, "region", "광주", False),
    ("[세종] 창업 지원", None, None, "region", "세종", False),
    ("세종대왕 데이터", None, None, None, "데이터", False),
    ("AI 과제 선정 결과 공고", None, None, "over", "선정 결과", False),
    ("데이터 바우처 [접수마감]", None, None, "over", "[접수마감]", False),
    ("농업 창업 지원", None, None, "unwanted", "농업", False),
    ("농업 AI 실증", None, None, None, "농업", True),
    ("바이오 창업", "데이터", None, "mildly_unwanted", "바이오", False),
    ("RETAIL UNIT TRAINING", None, None, "no_keyword", "", False),
    ("ＡＩ 실증", None, None, None, "AI", False),
    ("AIoT 실증", None, None, None, "AI", False),
    (None, None, None, "no_keyword", "", False),
]


def test_verdicts(spark):
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, title string, category string, department string")
    got = v.with_verdict(rows).orderBy("i").collect()
    for r, c in zip(got, CASES, strict=True):
        assert (r.reason, r.detail, r.overridden) == c[3:], c[0]


@pytest.mark.parametrize(
    ("title", "outcome", "theme"),
    [("AI 도면 검토", "main", "drawing_bim"), ("AI 데이터센터 건설", "infra", None), ("RAG로 건설 문서", "main", "aec_rag"), ("AI 건설", "main", "aec_ai"), ("AI 건설 특징주", "rejected", None), ("빵 굽기", "rejected", None), ("PAID construction", "rejected", None)],
)
def test_triage(spark, title, outcome, theme):
    r = spark.createDataFrame([(title,)], "t string").select(v.triage(F.col("t"), F.lit(None).cast("string")).alias("v")).first().v
    assert (r.outcome, r.theme) == (outcome, theme)


def test_judgements(spark):
    rows = spark.createDataFrame([(i,) for i in range(1, 6)], "no int")
    said = spark.createDataFrame([(1, 0.9, 1), (1, 0.1, 2), (2, 0.2, 3), (3, float("nan"), 4), (4, None, 5), (5, 7.0, 6), (9, 1.0, 7)], "no int, score double, at int")
    got = v.with_judgement(rows, "no", said, 0.6)
    assert [(r.score, r.outcome) for r in got.orderBy("no").collect()] == [(0.9, "passed"), (0.2, "rejected"), (None, "unjudged"), (None, "unjudged"), (1.0, "passed")]
    assert not v.circuit_open(got, "no")
    assert v.circuit_open(got.where("no <> 1").withColumn("score", F.lit(None).cast("double")), "no")
    assert not v.circuit_open(got.limit(0), "no")


def test_windows_and_languages(spark):
    rows = spark.createDataFrame([("한글", "2031-01-01 00:30:00"), ("plain", "2031-01-03 00:00:00"), ("ab", None)], "t string, a string").select("t", F.to_timestamp("a").alias("a"))
    now = F.lit("2031-01-01 00:00:00").cast("timestamp")
    got = rows.select(v.in_window(F.col("a"), F.lit("2030-12-31").cast("timestamp"), now), v.right_language(F.col("t"), F.lit(True)), F.col("t").rlike(v.EMPTY_TITLE)).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, False, False), (False, False, True)]
