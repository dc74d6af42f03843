"""Lists, details and attachments of some sites, told by selectors over their pages' nodes.

`page` are the columns that tell pages apart. Addresses on a site are completed by its own; of files with one address the
first is taken. What a page lacks gives no rows, '' or null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.functions import dates, text
from lathework.sources.nodes import Field, details, records

#: A department's last letters, and the marks of sizes behind the names of files.
DEPARTMENT = "(팀|부|실|센터|단|본부|처|국|과)$"
SIZE = r"(?i)\s*(?:\(\s*파일\s*크기\s*:[^)]*\)|\[\s*[\d.,]+\s*(?:[KMGT]?B|bytes?)\s*\])\s*$"
#: Letters of a detail page's text that are kept.
CONTENT = 5000


def _end(date: Column) -> Column:
    return dates.end_of_day(dates.source_date(date))


def _known(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def startup_list(nodes: DataFrame, page: list[str]) -> DataFrame:
    """A list of cards: the kind and the days left are flags above, the rest labelled or unlabelled parts below."""
    rows = records(nodes, page, "div#bizPbancList > ul > li", {
        "view": Field("div.middle a", "href", r"go_view(?:_blank)?\("),
        "given": Field("input", "value", having=("name", "scrap_list_bizPbancNm")),
        "shown": Field("div.middle p.tit"),
        "flags": Field("div.top span.flag", "each"),
        "parts": Field("div.bottom span.list", "each"),
    })
    marked = lambda mark: F.filter("flags", lambda f: f["path"].rlike(rf"\.{mark}(?:[.#]|$)"))
    kinds = F.filter("flags", lambda f: ~f["path"].rlike(r"\.(?:agency|day)(?:[.#]|$)"))
    label = r"^(등록일자|시작일자|마감일자|조회)\s*(.*)$"
    part = lambda name: F.get(F.filter("parts", lambda p: F.regexp_extract(p["text"], label, 1) == name), F.lit(0))["text"]
    told = lambda name: F.regexp_extract(part(name), label, 2)
    made = rows.select(
        *page, "position", F.regexp_extract("view", r"\((\d+)\)", 1).alias("id"), F.coalesce(_known(F.col("given")), _known(F.col("shown"))).alias("title"),
        F.get(kinds, F.lit(0))["text"].alias("category"), F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(marked("day"), lambda f: f["text"])), -1).alias("day_label"),
        _end(told("마감일자")).alias("deadline"), dates.source_date(told("등록일자")).alias("posted_date"),
        F.get(F.filter("parts", lambda p: ~p["text"].rlike(label)), F.lit(1))["text"].alias("organization"),
    )
    return made.where("id <> '' and title is not null")


def last_page(nodes: DataFrame, page: list[str]) -> DataFrame:
    """(page columns, last_page): the highest number that a list's own links or its active one tell; null if there is none."""
    told = records(nodes, page, "div.paginate", {"active": Field("a.active")})
    inner = records(nodes, page, "div.paginate a", {"href": Field("", "href"), "click": Field("", "onclick")})
    linked = F.regexp_extract(F.concat_ws(" ", "href", "click"), r"fn_egov_link_page\((\d+)\)", 1)
    each = inner.select(*page, linked.alias("n")).unionByName(told.select(*page, F.regexp_extract("active", r"^(\d+)$", 1).alias("n")))
    return each.groupBy(*page).agg(F.max(F.nullif("n", F.lit("")).cast("int")).alias("last_page"))


def period_list(nodes: DataFrame, page: list[str]) -> DataFrame:
    """A table whose third cell holds the link, the programme and the period; people's names in place of departments do not count."""
    rows = records(nodes, page, "table tbody tr", {
        "href": Field("td:3 a", "href", r"/home/2-2/\d+"), "title": Field("td:3 a"), "blue": Field("td:3 span.bluebox"), "box": Field("td:3 span.box"),
        "period": Field("td:3 span.bco"), "day_label": Field("td:2"), "author": Field("td:4"), "posted": Field("td:5"),
    })
    made = rows.select(
        *page, "position", F.regexp_extract("href", r"/home/2-2/(\d+)", 1).alias("id"), "title", F.coalesce(_known(F.col("blue")), _known(F.col("box"))).alias("category"), "day_label",
        _end(F.regexp_extract("period", r"[~～]\s*([0-9.\-/ ]+[0-9])", 1)).alias("deadline"), F.when(F.col("author").rlike(DEPARTMENT), F.col("author")).otherwise("NIPA").alias("organization"),
        dates.source_date("posted").alias("posted_date"),
    )
    return made.where("id <> '' and title <> ''")


@dataclass(frozen=True)
class Details:
    """Where a site's detail pages have their labels and values, and their files: each one's element, name and address."""

    label: str
    value: str
    file: str
    name: str
    link: str
    base: str
    address: str = ""
    kind: str = ""
    first: bool = False


#: The details of five sites.
STARTUP = Details("div.table_inner *.tit", "div.table_inner *.txt", "li.clear", "a.file_bg", "a.btn_down", "https://www.k-startup.go.kr", first=True)
BUSINESS = Details("div.view_cont > ul > li span.s_title", "div.view_cont > ul > li div.txt", "div.attached_file_list li", "*.file_name", "a.icon_download", "https://www.bizinfo.go.kr", kind="div.attached_file_list h3")
PERIODS = Details("table.tb05 tr > td:1", "table.tb05 tr > td:2", "a", "", "", "https://www.nipa.kr", address="/comm/getFile")
VENTURES = Details("th", "td", "td.file_list li", "span.name", "a", "https://www.mss.go.kr", address="(?i)download", first=True)
INFORMATION = Details("th", "td", "div.fileNew_area span.file_nm", "a", "a", "https://www.nia.or.kr")


def detail_fields(nodes: DataFrame, page: list[str], site: Details) -> DataFrame:
    """(page columns, details): the labelled values of detail pages."""
    return details(nodes, page, site.label, site.value, site.first)


def detail_content(nodes: DataFrame, page: list[str], site: Details) -> DataFrame:
    """(page columns, content): a line for each labelled value, as on the page, at most CONTENT characters."""
    fields = F.map_entries("details")
    line = lambda e: F.concat(F.lit("["), e["key"], F.lit("] "), e["value"])
    return detail_fields(nodes, page, site).select(*page, F.substring(F.array_join(F.transform(fields, line), "\n"), 1, CONTENT).alias("content"))


def escaped_body(nodes: DataFrame, page: list[str], element: str = "textarea#editContents") -> DataFrame:
    """(page columns, body): the text of markup that stands, escaped, as the text of an element."""
    return records(nodes, page, element, {"markup": Field()}).select(*page, text.html_to_text("markup").alias("body"))


def files(nodes: DataFrame, page: list[str], site: Details) -> DataFrame:
    """(page columns, position, name, url, kind): the attached files of detail pages, each address once.

    `kind` is the heading that a list of files stands under, or null. Sizes behind names are taken off.
    """
    listed = records(nodes, page, site.file, {"name": Field(site.name), "href": Field(site.link, "href", site.address)})
    listed = listed.withColumn("kind", F.lit(None).cast("string"))
    if site.kind:
        heads = records(nodes, page, site.kind, {"kind": Field()}).withColumns({"name": F.lit(""), "href": F.lit(None).cast("string")})
        before = Window.partitionBy(*page).orderBy("position")
        listed = listed.unionByName(heads.select(*listed.columns)).withColumn("kind", F.last("kind", ignorenulls=True).over(before))
    href = F.trim("href")
    url = F.when(href.rlike("^[a-z]+:"), href).when(F.startswith(href, F.lit("/")), F.concat(F.lit(site.base), href)).otherwise(F.concat(F.lit(f"{site.base}/"), href))
    named = listed.select(*page, "position", F.regexp_replace("name", SIZE, "").alias("name"), url.alias("url"), "kind", href.alias("_href"))
    named = named.where("name <> '' and _href <> '' and not lower(_href) like 'javascript%'")
    first = named.groupBy(*page, "url").agg(F.min_by(F.struct("position", "name", "kind"), "position").alias("_f"))
    return first.select(*page, "_f.position", "_f.name", "url", "_f.kind")
