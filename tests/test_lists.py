"""Lists out of feeds, pages and JSON."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lathework.sources import lists

RSS = """<?xml version="1.0"?><rss xmlns:dc="d"><channel><title>c</title><item><title>One  title</title><link> https://a.example/1 </link><guid>g1</guid><pubDate>Tue, 04 Mar 2031 10:00:00 GMT</pubDate>
<description>&lt;p&gt;Text&lt;/p&gt;</description><dc:creator>Ann, Bob</dc:creator><category>x</category><category>y</category><source url="https://s.example">S</source></item>
<item><title>Two</title><link>https://a.example/2</link><pubDate>Tue, 04 Mar 2031 10:00:00 +0900</pubDate></item></channel></rss>"""
ATOM = """<feed xmlns="a"><entry><title>Three</title><id>i3</id><updated>2031-03-04T10:00:00Z</updated><link rel="self" href="no"/><link href="https://a.example/3"/><summary>s</summary></entry></feed>"""


def test_feeds(spark):
    pages = spark.createDataFrame([("r", RSS), ("a", ATOM), ("bad", "<html"), ("null", None)], "query string, content string")
    rows = {(r.query, r.position): r for r in lists.feed_rows(pages, "content").collect()}
    assert set(rows) == {("r", 0), ("r", 1), ("a", 0)}
    one, two, three = rows["r", 0], rows["r", 1], rows["a", 0]
    assert (one.title, one.link, one.summary, one.authors, one.tags, one.source, one.source_url, str(one.published)) == ("One title", "https://a.example/1", "Text", ["Ann", "Bob"], ["x", "y"], "S", "https://s.example", "2031-03-04 10:00:00")
    assert (two.link, str(two.published), two.authors) == ("https://a.example/2", "2031-03-04 01:00:00", [])
    assert (three.link, three.guid, str(three.published)) == ("https://a.example/3", "i3", "2031-03-04 10:00:00")


def test_tables(spark):
    row = lambda n, org="가온원": f'<tr><td>{n}</td><td>기술</td><td><a href="/v?pblancId=PBLN_{n}">가온 &amp;  나래 {n}</a></td><td>2031-03-01 ~ 2031-03-31</td><td>나래부</td><td>{org}</td><td>2031-02-28</td></tr>'
    pages = [(1, f"<table>{row(1)}{row(2, '직접수행')}<tr><td>없음</td></tr></table>"), (2, f"<table>{row(1)}<tr><td>x<td>y"), (3, None)]
    got = lists.table_rows(spark.createDataFrame(pages, "page int, html string"), "html", "page", lists.BUSINESS).orderBy("id").collect()
    assert [(r.id, r.page, r.title, str(r.deadline), r.department, r.organization, str(r.posted_date)) for r in got] == [
        ("PBLN_1", 1, "가온 & 나래 1", "2031-03-31 23:59:59", "나래부", "가온원", "2031-02-28"),
        ("PBLN_2", 1, "가온 & 나래 2", "2031-03-31 23:59:59", "나래부", "나래부", "2031-02-28"),
    ]
    assert got[0].url.endswith("pblancId=PBLN_1")


def test_json(spark):
    answers = [(1, json.dumps({"listBsnsAncmBtinSitu": [{"ancmId": "7", "ancmTl": " t ", "rcveEndDe": "2031.11.16", "ancmDe": "2031-10-15"}, {"ancmId": None, "ancmTl": "x"}]})), (2, "no json"), (3, None)]
    got = lists.json_rows(spark.createDataFrame(answers, "page int, body string"), "body", "page", lists.PROJECTS).collect()
    assert [(r.id, r.title, str(r.deadline), str(r.posted_date), r.department) for r in got] == [("7", "t", "2031-11-16 23:59:59", "2031-10-15", "과학기술정보통신부")]
    events = [(1, json.dumps({"data": [{"encodedId": "e", "title": "t", "applyEndDt": "2031-01-02 18:00:00", "summary": "s" * 300}]}))]
    r = lists.json_rows(spark.createDataFrame(events, "page int, body string"), "body", "page", lists.EVENTS).first()
    assert (str(r.deadline), len(r.summary), r.url) == ("2031-01-02 23:59:59", 200, "https://jointips.or.kr/contents/events/detail?eventId=e")


def test_links_and_details(spark):
    page = '<table><tr><th>기간</th><td>a<br>b</td><th>담당</th><td>c</td></tr><tr><th>기간</th><td>d</td></tr></table><a href="/n/1">First link</a><a href="/n/1">Again it</a><a href="/x/2">Other link</a><a href="/n/3">abc</a>'
    frame = spark.createDataFrame([("p", page), ("q", None)], "page string, html string")
    assert [(r.page, r.url, r.title) for r in lists.link_rows(frame, "html", "^/n/").collect()] == [("p", "/n/1", "First link")]
    assert [r[0] for r in frame.select(lists.opened("html")["details"]).collect()] == [{"담당": "c", "기간": "d"}, {}]


def test_union(spark):
    make = lambda s, n: spark.createDataFrame([(s, i) for i in range(n)], "s string, i int")
    got = lists.ordered_union([(make("a", 5), 2), (make("b", 1), 3)], "i").orderBy("ord").collect()
    assert [(r.s, r.i) for r in got] == [("a", 0), ("a", 1), ("b", 0)]
    assert lists.with_fallback(make("a", 1).limit(0), lambda: make("b", 2)).count() == 2
    assert lists.with_fallback(make("a", 1), lambda: 1 / 0).count() == 1
    assert lists.ordered_union([(make("a", 1), 1)], "i").select(F.max("ord")).first()[0] == 1
