"""Pages as rows of nodes, and lists and details that selectors alone tell; pages are made up here."""

from __future__ import annotations

import random
from datetime import date, datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lathework.sources import nodes, sites


def opened(spark, *pages):
    return nodes.node_rows(spark.createDataFrame(list(enumerate(pages)), "page int, html string"), "html")


def as_date(v):
    return v.date() if isinstance(v, datetime) else v


def test_intervals():
    """Elements contain what lies between their tags, whatever tags are left open."""
    made = nodes.page_nodes("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><th>3</table></p><br/>x<p>y<div>z")
    for n in made:
        inner = [m for m in made if n["begin"] < m["begin"] <= n["end"]]
        assert all(m["path"].startswith(n["path"] + "/") and m["end"] <= n["end"] and m["depth"] > n["depth"] for m in inner)
    texts = [n["path"] for n in made if n["tag"] == "#text"]
    assert texts[:4] == ["/ul[1]/li[1]/#text", "/ul[1]/li[2]/#text", "/ul[1]/li[2]/ul[1]/li[1]/#text", "/ul[1]/li[3]/#text"]
    assert texts[4:7] == ["/table[1]/tr[1]/td[1]/#text", "/table[1]/tr[1]/td[2]/#text", "/table[1]/tr[2]/th[1]/#text"]
    assert nodes.page_nodes(None) == nodes.page_nodes("") == []


def test_any_markup():
    r = random.Random(4)
    parts = ["<div>", "</div>", "<li>", "</ul>", "<ul class='a b/c' id=x>", "t", "<br>", "<td>", "</tr>", "<p>", "<!-- c -->", "<script>if (a<b)</script>", "&amp;", "<", "<a href>"]
    for _ in range(300):
        made = nodes.page_nodes("".join(r.choice(parts) for _ in range(r.randint(0, 30))))
        assert [n["begin"] for n in made] == list(range(len(made)))
        for n in made:
            assert all(m["path"].startswith(n["path"] + "/") == (m["begin"] <= n["end"]) for m in made if m["begin"] > n["begin"])


def test_selectors(spark):
    page = "<div id='l' class='box'><ul class='a b'><li class='x'>1<b>2</b></li><li class='xy'>3</li></ul></div><ul><li>4</li></ul>"
    found = lambda s: [r.t for r in nodes.records(opened(spark, page), ["page"], s, {"t": nodes.Field()}).orderBy("position").collect()]
    assert found("li") == ["1 2", "3", "4"]
    assert found("li.x") == ["1 2"]
    assert found("div#l li:2") == found("div.box > ul.b > li.xy") == ["3"]
    assert found("div > li") == []
    assert found("*.b > li") == ["1 2", "3"]
    with pytest.raises(ValueError, match="no such step"):
        nodes.selector("a[href]")


def test_node_table_in_sql(spark):
    """The relation answers questions in plain SQL: the innermost cell around each link."""
    opened(spark, "<table><tr><td>a<td><p><a href='/1'>x</a></table>", "<td><a>y</a>").createOrReplaceTempView("page_nodes")
    rows = spark.sql(
        "SELECT a.page, max_by(c.path, c.begin) AS cell FROM page_nodes a JOIN page_nodes c ON c.page = a.page AND c.begin < a.begin AND a.end <= c.end WHERE a.tag = 'a' AND c.tag = 'td' GROUP BY a.page, a.begin"
    )
    assert sorted(tuple(r) for r in rows.collect()) == [(0, "/table[1]/tr[1]/td[2]"), (1, "/td[1]")]


def card(number, title, flags, parts, given=None):
    top = "".join(f"<span class='flag {c}'>{t}</span>" for c, t in flags)
    bottom = "".join(f"<span class='list'> {p} </span>" for p in parts)
    hidden = f"<input type='hidden' name='scrap_list_bizPbancNm' value='{given}'>" if given else "<input name='other' value='no'>"
    return f"<li><div class='top'>{top}</div>{hidden}<div class='middle'><a href='#'>-</a><a href='javascript:go_view({number});'><p class='tit'>{title}</p></a></div><div class='bottom'>{bottom}</div></li>"


def test_cards(spark):
    parts = ["가온 사업", "나래원", "등록일자 2031-02-03", "시작일자 2031-02-04", "마감일자 2031-03-05", "조회 12"]
    flags = [("agency", "공공"), ("type01", "기술"), ("type02", "둘째"), ("day", "D-9")]
    cards = card(11, "가온 <b>공고</b>", flags, parts) + card(12, "shown", [("day", "D-1")], [], "given") + "<li><a href='/none'>등록된 데이터가 없습니다</a></li>"
    page = f"<div id='bizPbancList'><ul>{cards}</ul></div><ul><li>aside</li></ul><div class='paginate'><a href='javascript:fn_egov_link_page(2)'>2</a><a onclick='fn_egov_link_page(14)'>last</a><a class='active'>3</a></div>"
    got = [r.asDict() for r in sites.startup_list(opened(spark, page, None), ["page"]).orderBy("position").collect()]
    assert [(r["id"], r["title"], r["category"], r["day_label"], r["organization"], as_date(r["deadline"]), as_date(r["posted_date"])) for r in got] == [
        ("11", "가온 공고", "기술", "D-9", "나래원", date(2031, 3, 5), date(2031, 2, 3)),
        ("12", "given", None, "D-1", None, None, None),
    ]
    assert sites.last_page(opened(spark, page, "<p>"), ["page"]).collect()[0].last_page == 14


def test_table(spark):
    row = lambda href, author: f"<tr><td>1</td><td>D-3</td><td><a href='{href}'>가온 공고</a><span class='box'>사업</span> <span class='bco'>2031-01-02 ~ 2031-03-04</span></td><td>{author}</td><td>2031-01-01</td></tr>"
    page = f"<table class='tbgg'><thead><tr><th>no</th></tr></thead><tbody>{row('/home/2-2/77', '나래팀')}{row('/home/2-2/78?x=1', '홍길동')}{row('/home/3/1', '')}<tr><td colspan=5>없음</td></tr></tbody></table>"
    got = sites.period_list(opened(spark, page), ["page"]).orderBy("position").collect()
    assert [(r.id, r.title, r.category, r.organization, as_date(r.deadline)) for r in got] == [("77", "가온 공고", "사업", "나래팀", date(2031, 3, 4)), ("78", "가온 공고", "사업", "NIPA", date(2031, 3, 4))]


def test_details(spark):
    lines = "<div class='view_cont'><ul><li><span class='s_title'>기간</span><div class='txt'>a<br> b</div></li><li><span class='s_title'>대상</span><div class='txt'>c</div></li></ul></div>"
    held = "<div class='attached_file_list'><h3>첨부파일</h3><ul><li><span class='file_name'>f1.hwp [12.5 KB]</span><a class='icon_download' href='/d/1'>get</a></li></ul><h3>본문출력파일</h3><ul><li><span class='file_name'>f2.pdf</span><a class='icon_download' href='https://x.example/2'>get</a></li><li><span class='file_name'>f1 again</span><a class='icon_download' href='/d/1'>get</a></li></ul></div>"
    n = opened(spark, lines + held)
    assert sites.detail_fields(n, ["page"], sites.BUSINESS).collect()[0].details == {"기간": "a b", "대상": "c"}
    assert sites.detail_content(n, ["page"], sites.BUSINESS).collect()[0].content == "[기간] a b\n[대상] c"
    got = [(r.name, r.url, r.kind) for r in sites.files(n, ["page"], sites.BUSINESS).orderBy("position").collect()]
    assert got == [("f1.hwp", "https://www.bizinfo.go.kr/d/1", "첨부파일"), ("f2.pdf", "https://x.example/2", "본문출력파일")]


def test_headed_cells_and_escaped_body(spark):
    page = "<table><tr><th>공고번호<td>1-2<th>담당<td>나래과<tr><th>공고번호<td>twice<tr><th>빈</table><textarea id='editContents'>&lt;p&gt;첫 줄&lt;/p&gt;&lt;p&gt;둘 &amp;amp; 셋&lt;/p&gt;</textarea><table><tr><td class='file_list'><ul><li><span class='name'>공고.hwp <em>[1 KB]</em></span><a href='/x'>view</a><a href='/common/Download.do?k=1'>down</a><li><span class='name'>b</span><a href='javascript:download()'>d</a></ul></table>"
    n = opened(spark, page)
    assert sites.detail_fields(n, ["page"], sites.VENTURES).collect()[0].details == {"공고번호": "1-2", "담당": "나래과"}
    assert sites.escaped_body(n, ["page"]).collect()[0].body == "첫 줄\n둘 & 셋"
    assert [(r.name, r.url) for r in sites.files(n, ["page"], sites.VENTURES).collect()] == [("공고.hwp", "https://www.mss.go.kr/common/Download.do?k=1")]


def test_definitions_and_no_rows(spark):
    n = opened(spark, "<dl><dt>a<dd>1<dd>2<dt>b<dt>c<dd></dl>", "<p>")
    assert [tuple(r)[2:] for r in nodes.pairs(n, ["page"], "dt", "dd").orderBy("position").collect()] == [("a", "1"), ("c", "")]
    assert nodes.records(n.where(F.lit(False)), ["page"], "dl", {"t": nodes.Field()}).collect() == []
    assert [(r.name, r.url) for r in nodes.links(opened(spark, "<a href='/1'>x <b>y</b></a><a>z</a>"), ["page"]).collect()] == [("x y", "/1")]


def test_opening_is_bounded(monkeypatch):
    """A batch of pages is opened some nodes at a time, whole pages each; null, empty and last empty pages give no rows."""
    monkeypatch.setattr(nodes, "NODES", 8)
    pages = ["<p>a<b>c</b>", None, "<ul><li class='x'>1<li>2</ul>", "", *["<p>t</p>"] * 9, None]
    batch = pa.RecordBatch.from_pydict({"page": list(range(len(pages))), "html": pa.array(pages, pa.string())})
    made = list(nodes._opened(batch, "html"))
    assert len(made) > 2 and max(m.num_rows for m in made) <= 8 + 5
    got = [(r["page"], r["path"], r["attributes"]) for m in made for r in m.to_pylist()]
    assert got == [(k, n["path"], list(n["attributes"].items())) for k, p in enumerate(pages) for n in nodes.page_nodes(p)]


def test_details_of_several_kinds(spark):
    """Kinds of details that lie in each other are told apart in one pass, as by one pass each."""
    html = ["<dl><dt>A<dd>1<dt>B<dd><table><tr><th>T<td>x<th>U</table></dl>", "<table><tr><th>T<td>y</table>", "<p>none</p>"]
    opened = nodes.node_rows(spark.createDataFrame(list(enumerate(html)), "page int, html string"), "html")
    got = nodes.all_details(opened, ["page"], {"terms": ("dt", "dd"), "heads": ("th", "td")})
    want = {0: ({"A": "1", "B": "T x U"}, {"T": "x"}), 1: (None, {"T": "y"})}
    assert {r.page: (r.terms, r.heads) for r in got.collect()} == want
    assert {r.page: r.details for r in nodes.details(opened, ["page"], "dt", "dd").collect()} == {0: want[0][0]}
