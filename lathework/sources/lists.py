"""Lists of records out of landed feeds, pages and JSON answers. Reading the network is not done here.

Each source is told as a small specification; the rows come from expressions. Markup is opened by one Arrow UDF, since
Spark has no function for it; feeds and JSON by Spark's own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, StringType, StructField, StructType

from lathework.functions import dates

FEED = "channel struct<item: array<struct<title: string, link: string, guid: string, pubDate: string, description: string, author: string, creator: string, category: array<string>, source: struct<_VALUE: string, _url: string>>>>"
ATOM = "entry array<struct<title: string, id: string, updated: string, published: string, summary: string, content: string, link: array<struct<_href: string, _rel: string>>>>"
PLACEHOLDERS = ["", "기초자치단체", "직접수행"]


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def untagged(text: Column) -> Column:
    return squeezed(F.regexp_replace(text, r"<[^<>]+>", ""))


def feed_rows(pages: DataFrame, content: str) -> DataFrame:
    """The columns of `pages` but the content, and (position, title, link, guid, published, summary, authors, tags, source, source_url).

    RSS and Atom both; what is no feed gives no rows. Dates that can't be read are null.
    """
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "rowTag": "rss"}
    kept = [c for c in pages.columns if c != content]
    body = F.regexp_replace(content, r"(?s)^\s*(<\?xml.*?\?>)?(\s*<!--.*?-->)*\s*", "")
    rss, atom = F.from_xml(body, FEED, options), F.from_xml(body, ATOM, options)
    one = lambda x: F.struct(
        x["title"].alias("title"), F.trim(x["link"]).alias("link"), x["guid"].alias("guid"), dates.english_time(x["pubDate"]).alias("published"), x["description"].alias("summary"),
        F.filter(F.transform(F.split(F.coalesce(x["creator"], x["author"], F.lit("")), ","), lambda a: F.trim(a)), lambda a: a != "").alias("authors"),
        F.coalesce(x["category"], F.array().cast("array<string>")).alias("tags"), x["source"]["_VALUE"].alias("source"), x["source"]["_url"].alias("source_url"),
    )
    other = lambda x: F.struct(
        x["title"].alias("title"), F.get(F.filter(x["link"], lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"].alias("link"), x["id"].alias("guid"),
        F.coalesce(x["published"], x["updated"]).try_cast("timestamp").alias("published"), F.coalesce(x["summary"], x["content"]).alias("summary"), F.array().cast("array<string>").alias("authors"),
        F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("source_url"),
    )
    items = F.coalesce(F.transform(rss["channel"]["item"], one), F.transform(atom["entry"], other))
    rows = pages.select(*kept, F.posexplode(items).alias("position", "_item")).select(*kept, "position", "_item.*")
    return rows.withColumn("title", squeezed(F.col("title"))).withColumn("summary", untagged(F.col("summary")))


class _Rows(HTMLParser):
    """Table rows with their cells, and list items and links with their texts."""

    VOID = frozenset({"br", "img", "hr", "input", "meta", "link"})

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[dict]] = []
        self.links: list[dict] = []
        self.cell: dict | None = None
        self.link: dict | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
            self.cell = None
        elif tag in ("td", "th") and self.rows:
            self.cell = {"text": "", "href": None, "head": tag == "th"}
            self.rows[-1].append(self.cell)
        elif tag == "a":
            self.link = {"text": "", "href": dict(attrs).get("href")}
            self.links.append(self.link)
            if self.cell is not None and self.cell["href"] is None:
                self.cell["href"] = self.link["href"]
        if tag in self.VOID:
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.cell = None
        elif tag == "a":
            self.link = None

    def handle_data(self, data):
        for part in (self.cell, self.link):
            if part is not None:
                part["text"] += data


_CELL = StructType([StructField("text", StringType()), StructField("href", StringType()), StructField("head", BooleanType())])
_LINK = StructType([StructField("text", StringType()), StructField("href", StringType())])
_OPENED = StructType([StructField("rows", ArrayType(ArrayType(_CELL))), StructField("links", ArrayType(_LINK)), StructField("details", MapType(StringType(), StringType()))])


def page_lists(page: str | None) -> tuple[list, list, dict]:
    """Table rows, links, and details: what follows the heads of a table, of equal heads the last."""
    parser = _Rows()
    parser.feed(page or "")
    parser.close()
    for part in (*parser.links, *(c for r in parser.rows for c in r)):
        part["text"] = " ".join(part["text"].split())
    details = {a["text"]: b["text"] for r in parser.rows for a, b in zip(r, r[1:], strict=False) if a["head"] and not b["head"]}
    return [r for r in parser.rows if r], parser.links, details


@F.pandas_udf(_OPENED)
def opened(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(list(map(page_lists, pages)), columns=["rows", "links", "details"])


def link_rows(pages: DataFrame, html: str, pattern: str, least: int = 5) -> DataFrame:
    """(columns of pages but the markup, position, title, url): links whose address fits, each address once, the first."""
    kept = [c for c in pages.columns if c != html]
    links = F.filter(opened(html)["links"], lambda k: F.coalesce(k["href"], F.lit("")).rlike(pattern) & (F.length(k["text"]) >= least))
    each = pages.select(*kept, F.posexplode(links).alias("position", "_k"))
    return each.groupBy(*kept, F.col("_k.href").alias("url")).agg(F.min_by("_k.text", "position").alias("title"), F.min("position").alias("position"))


@dataclass(frozen=True)
class Table:
    """Where a list's columns stand in a row of cells, and how ids and addresses are made."""

    source: str
    title: int
    cells: dict[str, int]
    least: int
    id_pattern: str
    url: str
    fields: dict[str, Callable[[dict[str, Column]], Column]] = field(default_factory=dict)


@dataclass(frozen=True)
class Json:
    """A list in a JSON answer: its schema, the path of its array, and the columns by field."""

    source: str
    schema: str
    path: str
    id: str
    title: str
    url: str
    fields: dict[str, Callable[[Column], Column]] = field(default_factory=dict)


def _end(text: Column) -> Column:
    return dates.end_of_day(dates.source_date(text))


def _known(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


# The lists of three sources.
BUSINESS = Table(
    "bizinfo", 2, {"category": 1, "deadline": 3, "department": 4, "organization": 5, "posted_date": 6}, 7, r"pblancId=(PBLN_\d+)", "https://www.bizinfo.go.kr/sii/siia/selectSIIA200Detail.do?pblancId={}",
    {
        "category": lambda c: _known(c["category"]),
        "deadline": lambda c: _end(F.regexp_extract(c["deadline"], r"[~～]\s*([0-9.\-/ ]+[0-9])", 1)),
        "department": lambda c: _known(c["department"]),
        "organization": lambda c: F.when(F.trim(c["organization"]).isin(PLACEHOLDERS), _known(c["department"])).otherwise(_known(c["organization"])),
        "posted_date": lambda c: dates.source_date(c["posted_date"]),
    },
)
PROJECTS = Json(
    "iitp", "listBsnsAncmBtinSitu array<struct<ancmId: string, ancmTl: string, rcveStrDe: string, rcveEndDe: string, ancmDe: string, sorgnNm: string, blngGovdSeNm: string, dDay: int>>", "listBsnsAncmBtinSitu", "ancmId", "ancmTl",
    "https://www.iris.go.kr/contents/retrieveBsnsAncmView.do?ancmId={}",
    {"deadline": lambda r: _end(r["rcveEndDe"]), "department": lambda r: F.coalesce(_known(r["blngGovdSeNm"]), F.lit("과학기술정보통신부")), "organization": lambda r: F.coalesce(_known(r["sorgnNm"]), F.lit("정보통신기획평가원")), "posted_date": lambda r: dates.source_date(r["ancmDe"])},
)
EVENTS = Json(
    "jointips", "code int, total int, data array<struct<encodedId: string, title: string, eventStdNm: string, organizer: string, applyEndDt: string, applyEndDate: string, regDt: string, summary: string>>", "data", "encodedId", "title",
    "https://jointips.or.kr/contents/events/detail?eventId={}",
    {"department": lambda r: F.lit("TIPS"), "category": lambda r: _known(r["eventStdNm"]), "deadline": lambda r: _end(F.coalesce(r["applyEndDt"], r["applyEndDate"])), "organization": lambda r: _known(r["organizer"]), "posted_date": lambda r: dates.source_date(r["regDt"]), "summary": lambda r: _known(F.substring(F.trim(r["summary"]), 1, 200))},
)


def _named(rows: DataFrame, source: str, url: str, order: list[str]) -> DataFrame:
    """Rows with an id and a title, each id once (the first by `order`), and the address made from the id."""
    whole = rows.where((F.coalesce("id", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != ""))
    first = whole.groupBy("id").agg(F.min_by(F.struct(*whole.columns), F.struct(*order)).alias("_r")).select("_r.*")
    return first.select(F.lit(source).alias("source"), *[c for c in first.columns if c != "url"], F.concat(F.lit(url.split("{}")[0]), "id", F.lit(url.split("{}")[1])).alias("url"))


def table_rows(pages: DataFrame, html: str, page: str, table: Table) -> DataFrame:
    """One row for each record of a list that is a table; rows with too few cells, no link or no id are none."""
    each = pages.select(F.col(page).alias("page"), F.posexplode(opened(html)["rows"]).alias("position", "_row")).where(F.size("_row") >= table.least)
    cell = {name: F.get("_row", F.lit(i))["text"] for name, i in table.cells.items()}
    link = F.get("_row", F.lit(table.title))
    rows = each.select("page", "position", F.regexp_extract(F.coalesce(link["href"], F.lit("")), table.id_pattern, 1).alias("id"), link["text"].alias("title"), *[f(cell).alias(n) for n, f in table.fields.items()])
    return _named(rows, table.source, table.url, ["page", "position"])


def json_rows(pages: DataFrame, content: str, page: str, spec: Json) -> DataFrame:
    """One row for each record of a list in a JSON answer; what is no JSON, and records without id or title, are none."""
    each = pages.select(F.col(page).alias("page"), F.posexplode(F.from_json(content, spec.schema)[spec.path]).alias("position", "_r"))
    rows = each.select("page", "position", F.trim(f"_r.{spec.id}").alias("id"), F.trim(f"_r.{spec.title}").alias("title"), *[f(F.col("_r")).alias(n) for n, f in spec.fields.items()])
    return _named(rows, spec.source, spec.url, ["page", "position"])


def with_fallback(first: DataFrame, other: Callable[[], DataFrame]) -> DataFrame:
    """The first list, or the other if that has no rows; the other is not read before."""
    return other() if first.isEmpty() else first


def ordered_union(sources: list[tuple[DataFrame, int]], order: str) -> DataFrame:
    """Sources in order of priority, each up to its quota of rows by `order`; `ord` tells the order over all.

    The quota is what a source may bring in one run.
    """
    out = None
    for n, (rows, quota) in enumerate(sources):
        ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(n)).orderBy(order))).where(F.col("_n") <= quota)
        one = ranked.withColumn("ord", F.lit(n).cast("long") * F.lit(1 << 32) + F.col("_n")).drop("_n")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
