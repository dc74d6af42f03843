"""Texts and messages out of rows. Sending them is the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.functions.text import escape_markup


def link(url: Column, label: Column) -> Column:
    """A link in chat markup; the characters that would end it are escaped in both parts."""
    plain = F.replace(F.replace(F.replace(url, F.lit("|"), F.lit("%7C")), F.lit(">"), F.lit("%3E")), F.lit("<"), F.lit("%3C"))
    return F.when(F.coalesce(url, F.lit("")) == "", escape_markup(label)).otherwise(F.concat(F.lit("<"), plain, F.lit("|"), escape_markup(label), F.lit(">")))


def people(names: Column, shown: int = 3) -> Column:
    """The first names, and how many more there are."""
    more = F.size(names) - shown
    return F.concat(F.array_join(F.slice(names, 1, shown), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(""))


def first_sentences(text: Column, n: int = 2) -> Column:
    kept = F.filter(F.transform(F.split(text, r"\."), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(kept) > 0, F.concat(F.array_join(F.slice(kept, 1, n), ". "), F.lit("."))).otherwise("")


def source_counts(rows: DataFrame, source: str, priority: DataFrame, names: int = 3) -> DataFrame:
    """One row: the sources with the most rows by name and how many other sources there are.

    `priority` has (source, priority, name). The names shown are the feature; all sources are counted.
    """
    n = rows.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n")).join(priority, "source", "left")
    ranked = n.groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.coalesce("priority", F.lit(1 << 30)).alias("p"), F.coalesce("name", F.col("source").cast("string")).alias("name")))).alias("all"))
    listed = F.array_join(F.transform(F.slice("all", 1, names), lambda x: x["name"]), ", ")
    return ranked.select(F.concat(listed, F.when(F.size("all") > names, F.concat(F.lit(" and "), (F.size("all") - names).cast("string"), F.lit(" more"))).otherwise("")).alias("text"))


def page_titles(rows: DataFrame, group: list[str], order: list[Column], size: int = 10) -> DataFrame:
    """`rows` with `page` from 0 and `range`: which of how many a page shows."""
    by = Window.partitionBy(*group)
    placed = rows.withColumn("_n", F.row_number().over(by.orderBy(*order))).withColumn("_all", F.count("*").over(by)).withColumn("page", F.floor((F.col("_n") - 1) / size).cast("int"))
    last = F.least((F.col("page") + 1) * size, F.col("_all"))
    return placed.withColumn("range", F.concat((F.col("page") * size + 1).cast("string"), F.lit("~"), last.cast("string"), F.lit("/"), F.col("_all").cast("string"))).drop("_n", "_all")


def messages(blocks: DataFrame, group: str, order: str, heading: str, text: str, most_blocks: int = 50, most_chars: int = 12_000) -> DataFrame:
    """(group, message, blocks, text): blocks in order, as many in each message as fit, no heading as a message's last.

    A heading is counted with the block behind it. A block longer than a message stands alone. Messages of one group are
    folded in one pass, so a group is what one reader gets, never a whole table.
    """
    item = F.struct(F.col(order).alias("o"), F.coalesce(heading, F.lit(False)).alias("h"), F.coalesce(text, F.lit("")).alias("t"))
    listed = blocks.groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("b"))
    at = lambda i: F.get("b", i)
    start = F.struct(F.array().cast("array<int>").alias("of"), F.lit(0).alias("m"), F.lit(0).alias("n"), F.lit(0).alias("c"))

    def step(acc: Column, i: Column) -> Column:
        follows = at(i)["h"] & at(i + 1).isNotNull()
        n, c = 1 + F.when(follows, 1).otherwise(0), F.length(at(i)["t"]) + F.when(follows, F.length(at(i + 1)["t"])).otherwise(0)
        full = (acc["n"] > 0) & ((acc["n"] + n > most_blocks) | (acc["c"] + c > most_chars))
        m = acc["m"] + F.when(full, 1).otherwise(0)
        return F.struct(F.array_append(acc["of"], m).alias("of"), m.alias("m"), F.when(full, 1).otherwise(acc["n"] + 1).alias("n"), (F.when(full, 0).otherwise(acc["c"]) + F.length(at(i)["t"])).alias("c"))

    of = F.aggregate(F.sequence(F.lit(0), F.size("b") - 1), start, step, lambda acc: acc["of"])
    each = listed.withColumn("_of", of).select(group, F.posexplode("b").alias("_i", "_b"), "_of").withColumn("message", F.get("_of", F.col("_i")))
    return each.groupBy(group, "message").agg(F.count("*").alias("blocks"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", F.col("_b.t").alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def html_rows(title: Column, url: Column, note: Column) -> Column:
    """A list item of a report in HTML, everything escaped."""
    quoted = F.replace(escape_markup(F.coalesce(url, F.lit(""))), F.lit('"'), F.lit("&quot;"))
    return F.concat(F.lit('<li><a href="'), quoted, F.lit('">'), escape_markup(F.coalesce(title, F.lit(""))), F.lit("</a> "), escape_markup(F.coalesce(note, F.lit(""))), F.lit("</li>"))


def notes(errors: DataFrame, warnings: DataFrame, text: str, most: int = 200) -> DataFrame:
    """(kind, text) of errors, then warnings, each cut to `most` characters."""
    kind = lambda rows, k, n: rows.select(F.lit(n).alias("position"), F.lit(k).alias("kind"), F.substring(text, 1, most).alias("text"))
    return kind(errors, "error", 0).unionByName(kind(warnings, "warning", 1))
