"""Quotas, caps, groups, pages and orders. Every order ends in a column that tells rows apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quota(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group. Spark keeps n rows a group before it shuffles, so a large group is no single task's."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def top(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of all, in order."""
    return rows.orderBy(*order).limit(n)


def interleaved(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n of each group with `turn`, by which (then by group) the groups take turns."""
    return quota(rows, [group], order, n).withColumnRenamed("rank", "turn")


def grouped(rows: DataFrame, group: Column, lead: list[Column], value: str) -> DataFrame:
    """(group, lead, others, size): a story's leading row and the rest, in order."""
    names = [f"o{i}" for i in range(len(lead))]
    item = F.struct(*[c.alias(n) for c, n in zip(lead, names, strict=True)], F.col(value).alias("v"))
    each = rows.groupBy(group.alias("story")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return each.select("story", F.col("items")[0]["v"].alias("lead"), F.transform(F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(1))), lambda x: x["v"]).alias("others"), F.size("items").alias("size"))


def paged(rows: DataFrame, group: list[str], order: list[Column], size: int) -> DataFrame:
    """`rows` with `page` from 0 and `place` from 1 within the group."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("place", place).withColumn("page", F.floor((F.col("place") - 1) / size).cast("int"))


def within_budget(rows: DataFrame, group: list[str], order: list[Column], full: Column, short: Column, budget: int) -> DataFrame:
    """`rows` with `whole`: false for the first rows by `order` whose bodies have to go so that the group fits its budget."""
    by = Window.partitionBy(*group)
    saved = F.sum(full - short).over(by.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("whole", F.coalesce(saved, F.lit(0)) >= F.sum(full).over(by) - budget)


def milestones(days: Column, before: Column, marks: tuple[int, ...] = (7, 3)) -> Column:
    """Whether a countdown has just passed one of the marks; -1 before means that it was not known."""
    return F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: (days <= m) & ((before == -1) | (before > m))) & (days > 0)
