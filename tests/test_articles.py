"""Bodies of articles, character sets, ids, snippets and broken answers."""

from __future__ import annotations

import base64

import pytest
from pyspark.sql import functions as F

from lathework.functions import articles as a


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, None),
        ("", ""),
        ("<p>one<p>two", "one\ntwo"),
        ("<div class='x'>out</div><div itemprop='articleBody'><p>in &amp; in</p><div class='related-news'>no</div><script>no</script></div>", "in & in"),
        ("<div id='article-body'>short</div><div class='story-body'><p>the longer</p>one</div><p>out", "the longer\none"),
        ("<div class='entry-content'><p>text</p><section><h3>Related Articles</h3><ul><li>no</li></ul></section></div>", "text"),
        ("<nav>no</nav><div class='content-stage'>yes</div><div class='ad'>no</div>", "yes"),
        ("<p>He wrote more on Gaon than others", "He wrote more on Gaon than others"),
    ],
)
def test_body(page, want):
    assert a.body_text(page) == want


def test_character_sets():
    assert a.decode_page("가온 똠".encode("cp949"), "EUC_KR") == "가온 똠"
    assert a.decode_page(b'<meta charset="euc-kr">' + "가".encode("euc-kr"), "ISO-8859-1").endswith("가")
    assert a.decode_page("가".encode(), None) == a.decode_page("가".encode(), "no-such-set") == "가"
    assert a.decode_page(b"\xff", None) == "�"
    assert a.decode_page(None, None) is None


def test_ids():
    make = lambda url: base64.urlsafe_b64encode(b"\x08\x13\x22" + (bytes([len(url)]) if len(url) < 128 else bytes([len(url) & 127 | 128, len(url) >> 7])) + url.encode() + b"\xd2\x01\x00").decode().rstrip("=")
    for url in ("https://a.example/x", "https://a.example/" + "y" * 300):
        assert a.url_of_id(make(url)) == url
    assert a.url_of_id(make("AU_yqLabc")) is a.url_of_id("???") is a.url_of_id(None) is a.url_of_id("abc") is None


def test_columns(spark):
    row = ("<a href='u'>Gaon builds</a>&nbsp;<b>Daily</b> and more of the text", "Gaon builds", "Daily", "p" * 9, "f" * 9, 'x {"score": 7, "summary": "a \\"b\\"\\nc";, "reason": "no"}')
    r = spark.createDataFrame([row], "d string, t string, s string, p string, f string, j string")
    none = F.lit(None).cast("string")
    got = r.select(
        a.snippet(F.col("d"), F.col("t"), F.col("s")), a.snippet(none, none, none), a.detail(F.col("p"), F.col("f"), 20, 3), a.detail(F.col("p"), F.lit(""), 4), a.detail(none, none), a.recovered_score(F.col("j")), a.recovered_score(F.lit("x")),
        a.recovered_summary(F.col("j")), a.recovered_summary(F.lit("x")), a.article_id(F.lit("https://news.google.com/rss/articles/CBM?oc=5")), a.article_id(F.lit("https://x.example/articles/CBM")),
    ).first()
    assert tuple(got) == ("and more of the text", "", "ppp\n\n[첨부 공고문]\n" + "f" * 6, "pppp", None, 1.0, None, 'a "b"\nc', None, "CBM", None)


def test_article_column(spark):
    rows = spark.createDataFrame([("<p>x",), (None,)], "h string")
    assert [r[0] for r in rows.select(a.article_text("h")).collect()] == ["x", None]
