"""Every query that has SQL gives the rows of its SQL; the others are held against plain Python."""

from __future__ import annotations

import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from lathework import page_queries, record_queries, scan_queries, state_queries  # noqa: F401, they register their queries
from lathework.functions import text
from lathework.operators import lineage, sequence
from lathework.queries import ORACLE_SQL, QUERIES, flagship, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, tables, name):
    got = QUERIES[name](spark, SF)
    want = tables.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    place = [want.columns.index(c) for c in columns]
    rows = sorted(repr([r[c] for c in columns]) for r in got.collect())
    assert rows == sorted(repr([r[i] for i in place]) for r in want.fetchall())
    assert rows or name == "milestone_crossing"


def test_all_others_are_known():
    assert set(QUERIES) - set(ORACLE_SQL) == {"distinct_articles", "fuzzy_titles", "page_texts", "title_two_passes", "title_matches", "merged_copies", "packed_site_queries", "packed_messages", "page_links"}


def test_flagship(spark):
    rows = flagship(spark, SF).collect()
    assert rows
    assert [r.n_chars for r in rows] == sorted((r.n_chars for r in rows), reverse=True)


def test_fuzzy_titles(spark):
    names = {r.p_name for r in spark.read.parquet(f"{SF}/part.parquet").select("p_name").collect()}
    got = [r.p_partkey for r in QUERIES["fuzzy_titles"](spark, SF).collect()]
    assert len(got) == len(set(got)) <= len(names)



def test_page_texts(spark):
    for r in QUERIES["page_texts"](spark, SF).collect():
        assert "<p" not in r.text
        assert "track(" not in r.text


@pytest.mark.parametrize(
    ("page", "want"),
    [(None, None), ("", ""), ("a&amp;b<br>c", "a&b\nc"), ("<nav>x</nav><p>one  two</p><script>y</script><p>three", "one two\nthree"), ("<div><p>open", "open")],
)
def test_page_text(page, want):
    assert text.page_text(page) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://www.a.org/x/?utm_source=f&id=2", "a.org/x?id=2"),
        ("http://a.org/x", "a.org/x"),
        ("https://a.org/x/#part", "a.org/x"),
        ("https://a.org/x?b=1&a=2", "a.org/x?b=1&a=2"),
        ("https://m.A.org/X/amp?no=7&ref=x&MOD=1", "a.org/X?no=7"),
        ("https://m.org/ampere", "m.org/ampere"),
        (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(text.canonical_url(F.col("u"))).first()[0] == want


def test_titles(spark):
    rows = spark.createDataFrame([("A  title - Daily - Daily",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.clean_title(F.col("t"), "Daily")).collect()] == ["A title", None]
    assert [r[0] for r in rows.select(text.title_key(F.col("t"))).collect()] == ["atitledailydaily", ""]


def test_first_come(spark):
    pick = random.Random(5)
    links = {tuple(sorted(pick.sample(range(80), 2))) for _ in range(90)}
    stays = {}
    for n in sorted({x for pair in links for x in pair}):
        stays[n] = not any(stays[a] for a, b in links if b == n)
    got = sequence.first_come(spark.createDataFrame(sorted(links), "a int, b int"), "a", "b").collect()
    assert {r.id: r.stays for r in got} == stays
    assert len(got) == len(stays)
    assert sequence.first_come(spark.createDataFrame([], "a int, b int"), "a", "b").collect() == []
