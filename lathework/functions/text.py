"""Expressions over titles, texts, addresses and JSON; Python only where Spark has no function for it."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def title_key(title: Column) -> Column:
    """What two spellings of one title share: small letters and digits alone; null is empty."""
    return F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def clean_title(title: Column, outlet: str | Column) -> Column:
    """White space collapsed, and the outlet's name behind dashes taken off, however often it stands there; no name, nothing."""
    bare = F.trim(F.regexp_replace(title, r"\s+", " "))
    if isinstance(outlet, str):
        return F.regexp_replace(bare, rf"( - \Q{outlet}\E)+$", "")
    name = F.trim(F.coalesce(outlet, F.lit("")))
    quoted = F.concat(F.lit("( - \\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)+$"))
    return F.when(name == "", bare).otherwise(F.regexp_replace(bare, quoted, F.lit("")))


def clip(text: Column, most: int) -> Column:
    """At most `most` characters, and how many were left out."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(" ("), (F.length(text) - most).cast("string"), F.lit(" omitted)"))).otherwise(text)


def escape_markup(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


#: Parameters of an address that only tell where a reader came from.
TRACKING = r"(?i)^(utm_[a-z]+|ref|fbclid|gclid|cmpid|smid|taid|mod)="


def canonical_url(url: Column) -> Column:
    """Without scheme, www., m., /amp, closing slash, fragment and tracking parameters; other parameters stay in order."""
    bare = F.regexp_replace(F.trim(url), r"(?i)^[a-z]+://(www\.)?(m\.(?=[^/?#]*\.))?", "")
    place = F.lower(F.regexp_extract(bare, r"^([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[^/?#]*([^?#]*)", 1), r"/amp(?=/|$)", ""), r"/+$", "")
    query = F.filter(F.split(F.regexp_extract(bare, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    return F.concat(place, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://(?:www\.)?([^/?#]+)", 1)


def first_keyword(text: Column, keywords: list[str]) -> Column:
    """The first of the list, in the list's order, that the text holds; null if none."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(k)), k) for k in keywords])


def keyword_score(text: Column, keywords: list[str], full: int = 5) -> Column:
    """How many of the keywords the text holds, as a share of `full`, at most 1."""
    found = sum((F.contains(text, F.lit(k)).cast("int") for k in keywords), F.lit(0))
    return F.least(F.coalesce(found, F.lit(0)) / F.lit(float(full)), F.lit(1.0))


def excerpt(text: Column, word: str, width: int = 160) -> Column:
    """`width` characters to both sides of the first place of `word`, dots where more is left out; null if it is nowhere."""
    at = F.instr(text, word)
    begin = F.greatest(at - width, F.lit(1))
    end = F.least(at + len(word) - 1 + width, F.length(text))
    shown = F.concat(F.when(begin > 1, "...").otherwise(""), F.substring(text, begin, end - begin + 1), F.when(end < F.length(text), "...").otherwise(""))
    return F.when(at > 0, shown)


def unquoted(text: Column) -> Column:
    """A reply without the lines it quotes."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.startswith(F.ltrim(x), F.lit(">"))), "\n")


def json_object(text: Column) -> Column:
    """The widest {...} in a text as a variant; null if it is no JSON."""
    return F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0))


class _Text(HTMLParser):
    # Elements that are no text, and elements that end a line.
    SKIPPED = frozenset({"script", "style", "nav", "header", "footer", "aside", "noscript", "form"})
    BLOCKS = frozenset({"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol"})

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIPPED
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in self.SKIPPED and self.skip > 0
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def page_text(page: str | None) -> str | None:
    """The text of an HTML page: no scripts, navigation or forms, one line for each block."""
    if page is None:
        return None
    parser = _Text()
    parser.feed(page)
    parser.close()
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(parser.out).split("\n"))
    return "\n".join(x for x in lines if x)


@F.pandas_udf(StringType())
def html_to_text(pages: pd.Series) -> pd.Series:
    return pages.map(page_text, na_action="ignore")


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Character references, which may have been escaped twice."""
    return text.map(lambda x: html.unescape(html.unescape(x)), na_action="ignore")
