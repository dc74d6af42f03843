"""Bodies of articles out of raw pages, old article ids, snippets, and fields out of broken answers."""

from __future__ import annotations

import base64
import codecs
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lathework.functions.text import unescape

# What marks the body of an article, how the marks of blocks begin that are none of it and which whole marks are
# such, and elements by their kind. Each stands as it is compared.
BODY_MARKS = re.compile(
    r"articlebody|article-view-content|article_body|article-body|news_body|newsbody|news-body|story-news|article_txt|article-txt|art_body|view_con|article-content|article_content|"
    r"entry-content|post-content|story-body|caas-body|body-text|articletext"
)
NOISE_STARTS = [
    "relat", "popular", "recommend", "rank", "best", "most", "aside", "sidebar", "banner", "advert", "promo", "share", "sns", "social", "comment", "reporter", "byline", "copyright", "keyword",
    "newsletter", "subscribe", "footer", "header", "nav", "menu", "photo", "caption", "figcaption", "series", "more", "tag",
]
NOISE_WORDS = ["ad", "ads", "adv"]
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SKIPPED = {"script", "style", "noscript", "svg", "nav", "footer", "header", "aside", "form", "figure", "figcaption", "button", "select", "template", "iframe", "head", "title"}
BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol", "blockquote"}
#: A mark, at the beginning of a name or behind a blank, underscore, hyphen or colon, that tells a block apart from the body.
NOISE = re.compile(rf"(?:^|[\s_\-:])(?:{'|'.join(NOISE_STARTS)}|(?:{'|'.join(NOISE_WORDS)})(?![^\s_\-:]))")
LIST_HEADINGS = re.compile(
    r"(관련\s?기사|관련\s?뉴스|많이\s?본\s?(기사|뉴스)|인기\s?(기사|뉴스)|추천\s?기사|주요\s?뉴스|최신\s?기사|이\s?시각\s?(주요|인기)\s?뉴스|함께\s?보면\s?좋은\s?기사|"
    r"Related (Articles|Stories|Coverage|News|Content)|Recommended( for You| Reading| Stories)?|More (from|on) [A-Z][\w&.' -]{1,40}|Most (Read|Popular|Viewed)|Trending( Now)?|Read More|Top Stories)[\s:：>»›]*"
)
KOREAN_CHARSETS = frozenset({"euc-kr", "ks-c-5601-1987", "ksc5601"})
#: Characters of a page, of its attachment's heading, and of both that a judge reads.
PAGE_CHARS, DETAIL_CHARS = 2000, 6000


class _Node:
    __slots__ = ("tag", "strong", "weak", "parts")

    def __init__(self, tag: str, strong: bool = False, weak: bool = False) -> None:
        self.tag, self.strong, self.weak = tag, strong, weak
        self.parts: list[_Node | str] = []


class _Tree(HTMLParser):
    """Elements that may hold text; what is noise by its element or its marks is left out as it is met."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("")
        self.open = [self.root]
        self.off: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag in BLOCKS and not self.off:
                self.open[-1].parts.append("\n")
            return
        marks = " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower()
        strong = any(k == "itemprop" and (v or "").lower() == "articlebody" for k, v in attrs)
        weak = BODY_MARKS.search(marks) is not None
        told = strong or weak or tag in ("html", "body", "main")
        noise = tag in SKIPPED or (not told and NOISE.search(marks) is not None)
        if self.off or noise:
            self.off.append(tag)
            return
        node = _Node(tag, strong, weak)
        self.open[-1].parts.append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        if self.off:
            if tag in self.off:
                del self.off[len(self.off) - 1 - self.off[::-1].index(tag) :]
            return
        names = [n.tag for n in self.open]
        if tag in names[1:]:
            del self.open[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        if not self.off:
            self.open[-1].parts.append(data)


def _is_list_heading(part) -> bool:
    text = part if isinstance(part, str) else "".join(x for x in part.parts if isinstance(x, str)) if part.tag in ("h2", "h3", "h4", "h5", "strong", "b", "span", "p", "dt", "div") else ""
    return len(text) <= 40 and bool(LIST_HEADINGS.fullmatch(text.strip()))


def _tree_text(top: _Node) -> str:
    """The text below a node, one line for each block; what follows the heading of a list of articles ends its block."""
    out: list[str] = []
    todo: list[_Node | str] = [top]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part)
            continue
        parts = part.parts
        cut = next((i for i, p in enumerate(parts) if _is_list_heading(p)), len(parts))
        edge = ["\n"] if part.tag in BLOCKS else []
        todo += [*edge, *reversed(parts[:cut]), *edge]
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def body_text(page: str | None) -> str | None:
    """The body of an article: of what is declared as one, else of what is named like one the longest, else all text."""
    if page is None:
        return None
    tree = _Tree()
    tree.feed(page)
    tree.close()
    found: dict[str, list[_Node]] = {"strong": [], "weak": []}
    todo = [tree.root]
    while todo:
        node = todo.pop()
        for kind, nodes in found.items():
            if getattr(node, kind):
                nodes.append(node)
        todo += [p for p in node.parts if isinstance(p, _Node)]
    for nodes in found.values():
        if text := max(map(_tree_text, nodes), key=len, default=""):
            return text
    return _tree_text(tree.root)


def decode_page(raw: bytes | None, declared: str | None) -> str | None:
    """A page's text by the declared character set, that of its meta element, or UTF-8, the first that fits."""
    if raw is None:
        return None
    raw = bytes(raw)
    meta = re.search(rb"""<meta[^>]+charset=["']?\s*([\w-]+)""", raw[:8192], re.IGNORECASE)
    named = [c for c in (declared if (declared or "").lower() != "iso-8859-1" else None, meta and meta[1].decode("ascii", "ignore")) if c]
    for name in [*named, "utf-8"]:
        try:
            return raw.decode("cp949" if name.lower().replace("_", "-") in KOREAN_CHARSETS else codecs.lookup(name).name)
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("utf-8", "replace")


def url_of_id(article_id: str | None) -> str | None:
    """The address within an article id of the old kind: base64 of a tagged, length-prefixed address; null for others."""
    try:
        raw = base64.urlsafe_b64decode((article_id or "") + "=" * (-len(article_id or "") % 4))
    except ValueError:
        return None
    head = re.match(rb"\x08\x13\x22((?:[\x80-\xff])*[\x00-\x7f])", raw, re.DOTALL)
    if not head:
        return None
    size = sum((b & 0x7F) << (7 * i) for i, b in enumerate(head[1]))
    told = raw[head.end() : head.end() + size].decode("utf-8", "replace")
    return told if told.startswith(("http://", "https://")) and "�" not in told else None


@F.pandas_udf(StringType())
def article_text(pages: pd.Series) -> pd.Series:
    return pages.map(body_text, na_action="ignore")


@F.pandas_udf(StringType())
def decoded_page(raw: pd.Series, declared: pd.Series) -> pd.Series:
    return pd.Series([decode_page(r, d) for r, d in zip(raw, declared, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def decoded_id(ids: pd.Series) -> pd.Series:
    return ids.map(url_of_id, na_action="ignore")


def article_id(url: Column, host: str = "news.google.com") -> Column:
    """The id in an address of the search service; null for other addresses."""
    found = F.regexp_extract(url, rf"^https?://\Q{host}\E/(?:[^?#]*/)?(?:articles|read)/([^/?#]+)/?(?:[?#]|$)", 1)
    return F.nullif(found, F.lit(""))


def snippet(description: Column, title: Column, source: Column) -> Column:
    """A description without markup, title and source; empty unless more than 15 characters are left."""
    plain = F.trim(F.regexp_replace(unescape(F.regexp_replace(F.coalesce(description, F.lit("")), "<[^>]+>", " ")), r"(?U)\s+", " "))
    for part in (title, source):
        plain = F.when(F.coalesce(part, F.lit("")) != "", F.replace(plain, part, F.lit(" "))).otherwise(plain)
    left = F.trim(F.regexp_replace(plain, r"(?U)\s+", " "), F.lit(" -·|"))
    return F.when(F.length(left) > 15, left).otherwise("")


def detail(page: Column, attachment: Column, most: int = DETAIL_CHARS, of_page: int = PAGE_CHARS) -> Column:
    """What a judge reads: the page, shortened if there is an attachment, and then the attachment; null for neither."""
    page, attachment = F.nullif(page, F.lit("")), F.nullif(attachment, F.lit(""))
    head = F.concat(F.substring(page, 1, of_page), F.lit("\n\n[첨부 공고문]\n"))
    both = F.concat(head, F.substring(attachment, F.lit(1), F.greatest(F.lit(most) - F.length(head), F.lit(0))))
    return F.coalesce(both, F.substring(F.coalesce(page, attachment), 1, most))


def recovered_score(answer: Column) -> Column:
    """A score within 0 and 1 out of an answer that is no JSON any more."""
    said = F.regexp_extract(answer, r'"(?:relevance_|importance_)?score"\s*:\s*"?(-?[0-9]*\.?[0-9]+)', 1).try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), said)) + F.lit(0.0) * said


def recovered_summary(answer: Column) -> Column:
    """A summary out of such an answer: up to the next key, escapes undone."""
    rest = F.regexp_extract(answer, r'(?s)"summary"\s*:\s*"(.*)$', 1)
    body = F.regexp_replace(rest, r'(?s)"?[\s,;"]*"reason"\s*:.*$|"\s*\}.*$', "")
    plain = F.replace(F.replace(F.regexp_replace(body, r'[\s,;"]+$', ""), F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))
    return F.nullif(F.trim(plain), F.lit(""))
