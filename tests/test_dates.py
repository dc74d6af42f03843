"""Days out of texts and labels."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lathework.functions import dates
from lathework.functions.deadline_text import deadline_from_text, deadline_in

REF = dt.date(2031, 3, 10)
CASES = [
    ("접수기간 : 2031. 4. 1(화) ~ 2031. 4. 30(수) 18시", (2031, 4, 30)),
    ("신청 기간 2031-04-01 부터 2031-04-20 까지", (2031, 4, 20)),
    ("공모기간 2031.04.01 ~ 예산 소진 시", None),
    ("모집기한: ’31.5.2.", (2031, 5, 2)),
    ("접수기간 2031.12.20 ~ 1.10", (2032, 1, 10)),
    ("제출기한 : 5월 7일", (2031, 5, 7)),
    ("제출기한 : 6월 31일 또는 5월 7일", (2031, 5, 7)),
    ("접수기간: 1월 5일", (2031, 1, 5)),
    ("접수 마감일 기준 2030.1.1 이후 설립. 신청기간 ~ 6. 3.(화)", (2031, 6, 3)),
    ("신청기간 □ 발표일 2031.7.1 ■ 접수기한 2031.8.1", (2031, 8, 1)),
    ("등록마감일시 2031년 9월 3일", (2031, 9, 3)),
    ("마감일 2031.02.30", None),
    ("신청기간 4.1(화) - 4.10(목)", (2031, 4, 10)),
    ("신청기간 4.1(화)부터 상시", None),
    ("공고기한 없음 모집기간 5월 2일, 6월 9일", (2031, 5, 2)),
    ("접수기간 : 1. 3.(토) ~ 2. 1.", (2032, 2, 1)),
    ("접수기간 연장 안내: 접수기간 '31. 6. 1", (2031, 6, 1)),
    ("아무 말", None),
    ("", None),
    (None, None),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_deadline(text, want):
    assert deadline_in(text, REF) == (want and dt.datetime(*want, 23, 59, 59))


def test_deadline_column(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = rows.select("i", deadline_from_text("t", F.lit(REF)).alias("d")).orderBy("i").collect()
    assert [r.d for r in got] == [w and dt.datetime(*w, 23, 59, 59) for _, w in CASES]


def test_labels(spark):
    rows = spark.createDataFrame([("D-13", "2031. 4. 1."), ("d-day", "20310401"), ("오늘마감", "2031-04-01 09:00"), ("x", "x"), (None, None)], "l string, d string")
    got = rows.select(dates.d_day_from_label(F.col("l")), dates.source_date(F.col("d"))).collect()
    assert [r[0] for r in got] == [13, 0, 0, None, None]
    assert [str(r[1]) for r in got] == ["2031-04-01", "2031-04-01", "2031-04-01", "None", "None"]


def test_watermark_and_due(spark):
    now = F.lit("2031-03-10 09:00:00").cast("timestamp")
    rows = spark.createDataFrame([("2031-03-10 05:00:00",), ("2031-01-01 00:00:00",), ("2032-01-01 00:00:00",), (None,)], "a string").select(F.to_timestamp("a").alias("a"))
    assert [str(r[0]) for r in rows.select(dates.watermark(F.col("a"), now)).collect()] == ["2031-03-10 05:00:00", "2031-03-07 09:00:00", "2031-03-09 09:00:00", "2031-03-09 09:00:00"]
    due = rows.select(dates.due_label(F.col("a").cast("date"), F.lit(REF)))
    assert [r[0] for r in due.collect()] == ["today", "2031-01-01 over by 68", "2032-01-01", "none"]
    assert rows.select(dates.end_of_day(F.col("a").cast("date"))).first()[0] == dt.datetime(2031, 3, 10, 23, 59, 59)
    assert rows.select(dates.day_with_weekday(F.col("a"))).first()[0] == "3/10(월)"
