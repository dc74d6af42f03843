"""Tasks of boards: who has to do what by when, and the report of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.functions.dates import due_label


def tasks(pages: DataFrame, owner: str, roles: dict[str, str], active: list[str], part: str, due: list[str], no_part: str = "none") -> DataFrame:
    """(board, title, status, part, roles, due) of a person's active tasks.

    `pages` has (board, properties: a variant); `roles` names the people properties and how each is called. A due day is
    the end, else the start, of the first of `due` that has one.
    """
    at = lambda path, kind="string": F.try_variant_get("properties", path, kind)
    people = lambda p: F.coalesce(F.exists(at(f"$['{p}'].people", "array<struct<id: string>>"), lambda x: x["id"] == owner), F.lit(False))
    mine = F.array_compact(F.array(*[F.when(people(p), name) for p, name in roles.items()]))
    fields = at("$", "map<string, variant>")
    titles = F.filter(F.map_values(fields), lambda v: F.try_variant_get(v, "$.type", "string") == "title")
    title = F.trim(F.array_join(F.transform(F.try_variant_get(F.get(titles, 0), "$.title", "array<struct<plain_text: string>>"), lambda x: F.coalesce(x["plain_text"], F.lit(""))), ""))
    day = F.coalesce(*[F.coalesce(F.nullif(at(f"$['{d}'].date.end"), F.lit("")), F.nullif(at(f"$['{d}'].date.start"), F.lit(""))) for d in due])
    rows = pages.select("board", F.coalesce(title, F.lit("")).alias("title"), at("$.Status.status.name").alias("status"), F.coalesce(at(f"$['{part}'].select.name"), F.lit(no_part)).alias("part"), mine.alias("roles"), F.substring(day, 1, 10).try_cast("date").alias("due"))
    return rows.where((F.size("roles") > 0) & F.col("status").isin(active))


def report_order() -> list[Column]:
    """The nearest first, tasks without a day last."""
    return [F.col("due").asc_nulls_last(), F.col("board"), F.col("title")]


def task_line(as_of: Column) -> Column:
    return F.concat(F.lit("• `"), "part", F.lit("` *"), "title", F.lit("* - "), "board", F.lit(" · "), F.array_join("roles", "·"), F.lit(" · "), due_label(F.col("due"), as_of))


def report(rows: DataFrame, as_of: Column) -> DataFrame:
    """(status, n, text) with one line for each task of a status, in order. A person's tasks are few, so a status is one text."""
    nth = F.row_number().over(Window.partitionBy("status").orderBy(*report_order()))
    lines = rows.select("status", nth.alias("nth"), task_line(as_of).alias("line"))
    return lines.groupBy("status").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), "\n").alias("text"))


def board_counts(rows: DataFrame, boards: list[str]) -> DataFrame:
    """Tasks of every board, zeros shown, in the given order."""
    listed = rows.sparkSession.createDataFrame(list(enumerate(boards)), "position int, board string")
    return listed.join(rows.groupBy("board").agg(F.count("*").alias("n")), "board", "left").select("position", "board", F.coalesce("n", F.lit(0)).alias("n"))


def urgent(rows: DataFrame, as_of: Column) -> DataFrame:
    """What is due today, then what is late, the latest first; `days` over."""
    return rows.where(F.col("due") <= as_of).withColumn("days", F.datediff(as_of, "due")).orderBy((F.col("days") > 0).cast("int"), *report_order())
