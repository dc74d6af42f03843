"""Queries of lists and details read out of pages, which are written from the shared tables first; they join the other queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathework.queries import query
from lathework.sources import nodes
from lathework.sources.nodes import Field


def _written(rows: DataFrame, page: str, order: str, parts: list, before: str, after: str) -> DataFrame:
    """(page, html): the rows of each page, one after another."""
    row = F.struct(order, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("x"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda s: s["x"]), "")
    return rows.groupBy(F.expr(page).alias("page")).agg(F.concat(F.lit(before), body, F.lit(after)).alias("html"))


@query("SELECT c_custkey // 50 AS page, c_custkey::VARCHAR AS id, c_name || ' & co' AS title, c_mktsegment AS kind, CASE WHEN c_nationkey % 3 = 0 THEN 'n' || c_nationkey END AS nation FROM customer")
def table_pages(read):
    """Customers listed in tables of fifty rows, whose cells and rows are not closed."""
    nation = F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("<span class='a nation' title='n"), F.col("c_nationkey").cast("string"), F.lit("'>x</span>"))).otherwise("")
    parts = ["<tr><td>", F.col("c_custkey").cast("string"), "<td>", nation, "<a href='/view?id=", F.col("c_custkey").cast("string"), "'>", F.col("c_name"), " <b>&amp;</b>\n co</a><td class='seg'>", F.col("c_mktsegment")]
    pages = _written(read("customer"), "c_custkey div 50", "c_custkey", parts, "<p>list</p><table class='board'><thead><tr><th>no<tbody>", "</table><a href='/view?id=0'>top</a>")
    rows = nodes.records(nodes.node_rows(pages, "html"), ["page"], "table.board tbody tr", {"href": Field("td:2 a", "href"), "title": Field("td:2 a"), "kind": Field("td.seg"), "nation": Field("span.nation", "title")})
    return rows.select("page", F.regexp_extract("href", r"id=(\d+)", 1).alias("id"), "title", "kind", "nation")


@query("""SELECT s_suppkey // 20 AS page, s_name AS title, 'N' || s_nationkey AS kind, CASE WHEN s_acctbal < 0 THEN 'due' END AS label, 'S' || s_suppkey || '|' || s_nationkey AS parts FROM supplier""")
def card_pages(read):
    """Suppliers as cards: flags of several kinds, told apart by their classes, and parts in order."""
    due = F.when(F.col("s_acctbal") < 0, "<span class='flag day'>due</span>").otherwise("")
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    parts = ["<li class='card'><div class='top'><span class='flag agency'>x</span><span class='flag'>N", nation, "</span>", due, "</div><p class='tit'>", F.col("s_name"), "</p><span class='part'>S", key, "</span><span class='part'>", nation, "</span></li>"]
    pages = _written(read("supplier"), "s_suppkey div 20", "s_suppkey", parts, "<div id='list'><ul>", "</ul></div><ul><li class='card'>aside</li></ul>")
    rows = nodes.records(nodes.node_rows(pages, "html"), ["page"], "div#list > ul > li.card", {"title": Field("p.tit"), "flags": Field("div.top > span.flag", "each"), "parts": Field("span.part", "each")})
    flag = lambda keep: F.get(F.filter("flags", keep), F.lit(0))["text"]
    plain = flag(lambda f: ~f["path"].rlike(r"\.(?:agency|day)(?:[.#]|$)"))
    return rows.select("page", "title", plain.alias("kind"), flag(lambda f: f["path"].rlike(r"\.day(?:[.#]|$)")).alias("label"), F.array_join(F.transform("parts", lambda p: p["text"]), "|").alias("parts"))


@query("SELECT p_partkey, p_brand AS brand, CASE WHEN p_size % 5 <> 0 THEN p_size::VARCHAR ELSE '' END AS size, p_type AS kind FROM part")
def detail_pages(read):
    """Parts as detail pages: a list of terms, one of them without a value, and a row of heads and cells."""
    size = F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("string")).otherwise("")
    html = F.concat(F.lit("<dl><dt>Brand<dd>"), "p_brand", F.lit("<dt>None<dt> Size <dd>"), size, F.lit("</dl><table><tr><th>Type<td>"), "p_type", F.lit("<th>Rest<tr><td>no</table>"))
    # The table may be one small file, the opened pages are not.
    parts = read("part").select("p_partkey", "p_brand", "p_size", "p_type").repartition("p_partkey")
    opened = nodes.node_rows(parts.select("p_partkey", html.alias("html")), "html")
    told = nodes.all_details(opened, ["p_partkey"], {"terms": ("dt", "dd"), "heads": ("th", "td")}).where("terms is not null and heads is not null")
    return told.select("p_partkey", F.col("terms")["Brand"].alias("brand"), F.col("terms")["Size"].alias("size"), F.col("heads")["Type"].alias("kind"))
