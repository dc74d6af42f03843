"""Pages as relations: a row for each element and text of a page, and lists and details told by paths.

An element has the interval from `begin` to `end` of the page's nodes in order; one lies in another if its interval does. Its
`path` has a step for each element around it, /tag[n].class#id, where n counts the siblings of one tag from 1; a text's path
ends in /#text. So a path of steps is a pattern over paths, what lies in a record is found by one window over a page's
nodes, and all that follows groups by page and record, which the window's shuffle serves as well. Only the opening of
markup is a function in Python.

Selectors: steps with blanks between (`ul.list li`), or `>` for a direct child; a step is a tag or `*`, with `.class`, `#id`
and `:n` (the n-th of its tag) behind it, in this order. Within records they are relative; an empty one is the record itself.
Matching elements do not lie in each other: of nested ones the innermost that has begun last is taken.

Null and empty pages have no nodes. Broken markup is closed as browsers would: a row, cell, item, term or paragraph ends
where the next one begins, and everything with what is around it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, MapType, StringType, StructField, StructType

NODE = StructType([
    StructField("begin", IntegerType()), StructField("end", IntegerType()), StructField("depth", IntegerType()), StructField("tag", StringType()),
    StructField("path", StringType()), StructField("attributes", MapType(StringType(), StringType())), StructField("text", StringType()),
])

# Elements without an end, and which open elements a beginning one ends, as long as none of the others is between.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
ENDS = {
    "li": (["li"], ["ul", "ol"]), "dt": (["dt", "dd"], ["dl"]), "dd": (["dt", "dd"], ["dl"]), "option": (["option"], ["select"]), "p": (["p"], ["div", "td", "li", "section", "article"]),
    "tr": (["tr"], ["table"]), "td": (["td", "th"], ["tr", "table"]), "th": (["td", "th"], ["tr", "table"]), "tbody": (["thead", "tbody"], ["table"]),
}


class _Nodes(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[dict] = []
        self.siblings: list[Counter] = [Counter()]

    def _close(self, many: int) -> None:
        for _ in range(many):
            self.open.pop()["end"] = len(self.rows) - 1
            self.siblings.pop()

    def _add(self, tag: str, step: str, attributes: dict, text: str | None) -> dict:
        at = len(self.rows)
        path = (self.open[-1]["path"] if self.open else "") + step
        self.rows.append({"begin": at, "end": at, "depth": len(self.open), "tag": tag, "path": path, "attributes": attributes, "text": text})
        return self.rows[-1]

    def handle_starttag(self, tag, attrs):
        ended, held = ENDS.get(tag, ((), ()))
        for k, node in enumerate(reversed(self.open), 1):
            if node["tag"] in ended:
                self._close(k)
            if node["tag"] in ended or node["tag"] in held:
                break
        attributes = {k: v or "" for k, v in attrs}
        self.siblings[-1][tag] += 1
        marks = [f".{c}" for c in attributes.get("class", "").split()] + [f"#{i}" for i in attributes.get("id", "").split()[:1]]
        node = self._add(tag, f"/{tag}[{self.siblings[-1][tag]}]" + "".join(marks).replace("/", "_"), attributes, None)
        if tag not in VOID:
            self.open.append(node)
            self.siblings.append(Counter())

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(1)

    def handle_endtag(self, tag):
        for k, node in enumerate(reversed(self.open), 1):
            if node["tag"] == tag:
                self._close(k)
                break

    def handle_data(self, data):
        if data.strip():
            self._add("#text", "/#text", {}, data)


def page_nodes(page: str | None) -> list[dict]:
    """The nodes of one page in order."""
    parser = _Nodes()
    parser.feed(page or "")
    parser.close()
    parser._close(len(parser.open))
    return parser.rows


#: Nodes of an Arrow batch that the opening of markup returns, about; a page's are not parted between two.
NODES = 1 << 14


def _opened(batch: pa.RecordBatch, html: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch for each of their nodes, some pages at a time, so that memory does not grow with the batch."""
    kept = [i for i, name in enumerate(batch.schema.names) if name != html]
    pages = batch.column(batch.schema.get_field_index(html))
    at: list[int] = []
    rows: list[dict] = []
    for k in range(len(pages)):
        nodes = page_nodes(pages[k].as_py())
        at.extend([k] * len(nodes))
        rows.extend(nodes)
        if rows and (len(rows) >= NODES or k == len(pages) - 1):
            where = pa.array(at, pa.int64())
            columns = [pa.array([r[f.name] if f.name != "attributes" else list(r[f.name].items()) for r in rows], to_arrow_type(f.dataType)) for f in NODE]
            yield pa.RecordBatch.from_arrays([batch.column(i).take(where) for i in kept] + columns, [batch.schema.names[i] for i in kept] + NODE.names)
            at, rows = [], []


def node_rows(pages: DataFrame, html: str) -> DataFrame:
    """The columns of `pages` but the markup, and (begin, end, depth, tag, path, attributes, text), a row for each node."""
    kept = [f for f in pages.schema.fields if f.name != html]

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _opened(batch, html)

    return pages.mapInArrow(opened, StructType([*kept, *NODE.fields]))


_STEP = re.compile(r"([a-z0-9]+|\*)?((?:\.[^\s.#:>]+)*)(#[^\s.#:>]+)?(?::(\d+))?\Z")


def selector(path: str) -> str:
    """The pattern of the paths that a selector takes, without the end."""
    pattern = ""
    for child, step in re.findall(r"(>?)\s*([^\s>]+)", path):
        m = _STEP.match(step)
        if not m:
            raise ValueError(f"no such step: {step}")
        marks = [re.escape(c) for c in re.findall(r"[.#][^.#]+", (m[2] or "") + (m[3] or ""))]
        ahead = "".join(rf"(?=[^/]*{c.replace('/', '_')}(?:[.#/]|$))" for c in marks)
        tag = r"[a-z0-9]+" if m[1] in (None, "*") else m[1]
        pattern += ("" if child else "(?:/.*)?") + rf"/{tag}\[{m[4] or '[0-9]+'}\]{ahead}[^/]*"
    return f"^{pattern}"


def _selected(path: str) -> Column:
    """That an element is one of those which a selector takes; its tag is asked first, as a pattern costs more."""
    last = re.search(r"([a-z0-9]+)[^\s>]*\Z", path.split()[-1].split(">")[-1])
    fits = F.col("path").rlike(f"{selector(path)}$")
    return (F.col("tag") == last[1]) & fits if last and path.split()[-1].split(">")[-1].startswith(last[1]) else fits


def _text(matches: Column) -> Column:
    """The texts of the nodes that match, in order, white space collapsed."""
    found = F.sort_array(F.collect_list(F.when((F.col("tag") == "#text") & matches, F.struct("begin", "text"))))
    return F.trim(F.regexp_replace(F.array_join(F.transform(found, lambda t: t["text"]), " "), r"(?U)\s+", " "))


def _around(page: list[str], kinds: dict[str, str]) -> Column:
    """The element of one of the kinds (name: selector) that has begun last in a page: (begin, end, size of its path, kind)."""
    one = lambda k: F.struct("begin", "end", F.length("path").alias("size"), F.lit(k).alias("kind"))
    own = F.coalesce(*[F.when(_selected(s), one(k)) for k, s in kinds.items()])
    return F.last(F.when(F.col("tag") != "#text", own), ignorenulls=True).over(Window.partitionBy(*page).orderBy("begin"))


@dataclass(frozen=True)
class Field:
    """A selector within a record, and what is taken.

    `text`: the text of all that it finds; `each`: the texts one by one, with the path of each; else an attribute, of the
    first that has one which `matching` finds. `having` tells an attribute and its value that the element needs as well.
    """

    path: str = ""
    take: str = "text"
    matching: str = ""
    having: tuple[str, str] | None = None


def _each(element: Column) -> Column:
    """(path, text) of the elements, in order, whose paths are `element` in the rows of their texts."""
    found = F.sort_array(F.collect_list(F.when((F.col("tag") == "#text") & (element != ""), F.struct("begin", element.alias("path"), "text"))))
    text = lambda p: F.array_join(F.transform(F.filter(found, lambda t: t["path"] == p), lambda t: t["text"]), " ")
    squeezed = lambda t: F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    return F.transform(F.array_distinct(F.transform(found, lambda t: t["path"])), lambda p: F.struct(p.alias("path"), squeezed(text(p)).alias("text")))


def records(nodes: DataFrame, page: list[str], row: str, fields: dict[str, Field]) -> DataFrame:
    """A row for each element that `row` selects: the columns of `page`, its `position`, and its fields; what lacks is '' or null."""
    inside = nodes.withColumn("_r", _around(page, {"row": row})).where("end <= _r.end")
    inside = inside.withColumn("_path", F.substring("path", F.col("_r.size") + 1, F.length("path")))
    made = []
    for name, f in fields.items():
        own = selector(f.path)
        if f.take == "text":
            made.append(_text(F.col("_path").rlike(f"{own}(?:/.*)?/#text$")).alias(name))
        elif f.take == "each":
            made.append(_each(F.regexp_extract("_path", f"({own})(?:/.*)?/#text$", 1)).alias(name))
        else:
            value = F.when(F.col("_path").rlike(f"{own}$") & F.col("attributes")[f.take].rlike(f.matching), F.col("attributes")[f.take])
            if f.having:
                value = F.when(F.col("attributes")[f.having[0]] == f.having[1], value)
            made.append(F.min_by(value, F.when(value.isNotNull(), F.col("begin"))).alias(name))
    return inside.groupBy(*page, F.col("_r.begin").alias("position")).agg(*made)


def _beside(nodes: DataFrame, page: list[str], kinds: dict[str, tuple[str, str]]) -> DataFrame:
    """(columns of page, name, position, label, value) of `pairs` of several kinds (name: label, value), over one sort of a page's nodes."""
    wanted = F.col("tag") == "#text"
    for selectors in kinds.values():
        wanted = wanted | _selected(selectors[0]) | _selected(selectors[1])
    around = {name: _around(page, {"label": label, "value": value}) for name, (label, value) in kinds.items()}
    found = nodes.select(*page, "begin", "end", "tag", "path", "text").where(wanted)
    found = found.withColumn("_k", F.array(*[F.struct(F.lit(name).alias("name"), r.alias("r")) for name, r in around.items()]))
    inside = found.withColumn("_k", F.explode(F.filter("_k", lambda k: F.col("end") <= k["r"]["end"]))).withColumns({"name": F.col("_k.name"), "_r": F.col("_k.r")})
    each = inside.groupBy(*page, "name", F.col("_r.begin").alias("position"), F.col("_r.kind").alias("_kind")).agg(
        _text(F.lit(True)).alias("value"), F.min(F.when(F.col("begin") == F.col("_r.begin"), F.regexp_replace("path", "/[^/]*$", ""))).alias("_parent")
    )
    order = Window.partitionBy(*page, "name").orderBy("position")
    beside = (F.lag("_kind").over(order) == "label") & (F.lag("_parent").over(order) == F.col("_parent"))
    each = each.withColumn("label", F.when(beside, F.lag("value").over(order)))
    return each.where("_kind = 'value' and label is not null").select(*page, "name", "position", "label", "value")


def pairs(nodes: DataFrame, page: list[str], label: str, value: str) -> DataFrame:
    """(columns of page, position, label, value): each element that `value` selects, if the one before it is of `label` and in the same element."""
    return _beside(nodes, page, {"pairs": (label, value)}).drop("name")


def all_details(nodes: DataFrame, page: list[str], kinds: dict[str, tuple[str, str]], first: bool = False) -> DataFrame:
    """(columns of page, a map by name) of `details` of several kinds (name: label, value); null where a page has none of a kind."""
    told = _beside(nodes, page, kinds).where("label <> ''")
    one = F.min_by("value", F.when(F.col("value") != "", F.col("position"))) if first else F.max_by("value", "position")
    last = told.groupBy(*page, "name", "label").agg(F.coalesce(one, F.lit("")).alias("value"))
    held = lambda name: F.collect_list(F.when(F.col("name") == name, F.struct("label", "value")))
    made = last.groupBy(*page).agg(*[F.sort_array(held(name)).alias(name) for name in kinds])
    return made.select(*page, *[F.when(F.size(name) > 0, F.map_from_entries(name)).alias(name) for name in kinds])


def details(nodes: DataFrame, page: list[str], label: str, value: str, first: bool = False) -> DataFrame:
    """(columns of page, details): a map of labels to values; of equal labels the last, or the first that has a value."""
    return all_details(nodes, page, {"details": (label, value)}, first)


def links(nodes: DataFrame, page: list[str], row: str = "a") -> DataFrame:
    """(columns of page, position, name, url) of the links that `row` selects, such as a page's attachments."""
    return records(nodes, page, row, {"name": Field(), "url": Field("", "href")}).where("url is not null")
