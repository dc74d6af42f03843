"""Readable forms of searches and their limits."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lathework.functions import searches

CASES = {
    "(intitle:A OR intitle:B) intitle:C when:7d": "A · B × C",
    '(가 OR "나 다") 라 -마 -intitle:"바 사"': "가 · 나 다 × 라  (제외: 마, 바 사)",
    '"a (b OR c) d" e': "a (b OR c) d × e",
    '(a OR "b) c")': "a · b) c",
    "when:3d": "",
    "-x": "  (제외: x)",
    "": "",
    None: "",
    "()  a": "a",
}


def test_readable(spark):
    rows = spark.createDataFrame([(q, w) for q, w in CASES.items()], "q string, want string")
    for r in rows.select("q", "want", searches.readable_search(F.col("q")).alias("got")).collect():
        assert r.got == r.want, r.q


def test_too_long_a_search_is_an_error(spark):
    rows = spark.createDataFrame([("x" * 183,)], "t string")
    assert rows.select(searches.open_search(F.substring("t", 1, 182), F.lit(7)).alias("s")).first().s == "x" * 182 + " when:7d"
    with pytest.raises(Exception, match="search too long"):
        rows.select(searches.open_search(F.concat("t", F.lit("xx")), F.lit(7))).collect()
