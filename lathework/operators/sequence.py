"""Things that go by order, without all rows in one task: numbers of rows, running sums, and greedy choices over links.

A greedy choice over links takes rows in order and decides each by what became of the earlier rows it is linked to. Links
make components, and what one decides is nothing to another, so all components go on at once. Within one, rows go by
segments of a bounded number of links: a segment is one group of a task, which is given its links and the outcome of the
earlier segments, by a join. Most components are one segment; one of n links takes n / SEGMENT rounds, whatever its shape,
be it a chain or a band in which each row is linked to several before it.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.operators.lineage import components, cut

#: Links that a task settles at once, about: those to one row stay together.
SEGMENT = 1 << 16


def _places(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, Column, Column]:
    """`rows` sorted and stored with `_at`; the sort's task and the row's place there, from `_at`."""
    sorted_rows = cut(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    return sorted_rows, F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)


def _before(sums: DataFrame) -> DataFrame:
    """(task, base): what the tasks before have together. There are as many rows as the sort had partitions, whatever the data."""
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sums.select("task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")))


def numbered(rows: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """`rows` with their numbers from 0 in an order that tells all apart: a distributed sort and a count for each of its tasks."""
    placed, task, at = _places(rows, order)
    base = _before(placed.groupBy(task.alias("task")).agg(F.count("*").alias("n")))
    return placed.withColumn("_task", task).join(base, F.col("_task") == F.col("task")).withColumn(name, F.col("base") + at).drop("_at", "_task", "task", "base")


def running_sum(rows: DataFrame, order: list[Column], value: Column, name: str = "sum") -> DataFrame:
    """`rows` with the sum of `value` over all rows up to them: within the tasks of a sort, and over these tasks' totals.

    Nulls count as 0. The order has to tell all rows apart.
    """
    placed, task, _ = _places(rows.withColumn("_value", F.coalesce(value, F.lit(0))), order)
    placed = placed.withColumn("_task", task)
    base = _before(placed.groupBy(F.col("_task").alias("task")).agg(F.sum("_value").alias("n")))
    within = F.sum("_value").over(Window.partitionBy("_task").orderBy("_at"))
    return placed.withColumn(name, within).join(base, F.col("_task") == F.col("task")).withColumn(name, F.col(name) + F.col("base")).drop("_at", "_value", "_task", "task", "base")


def settle(links: DataFrame, decide: Callable[[list[tuple], dict], dict], state: str, segment: int | None = None) -> DataFrame:
    """(id, state) of every end of a link, by `decide` over the links of a segment after another.

    `links` has `a` and `b`, `a` being the earlier in the order of their values, and what else decide() wants, as columns.
    decide(rows, known) gets some rows' links, (b, a, others...) sorted by b and a, and the states of earlier segments'
    rows among the a; it returns the states of all rows of the segment, and anew those of earlier ones that it changed. A
    row that no link leads to comes as a link with a null `a`. `state` is the states' SQL type.
    """
    others = [c for c in links.columns if c not in ("a", "b")]
    kind = links.schema["b"].dataType.simpleString()
    links = cut(links.select("b", "a", *others))
    named = components(links, "a", "b")
    starts = named.join(links.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
    none = [F.lit(None).cast(links.schema[c].dataType).alias(c) for c in ("a", *others)]
    every = links.unionByName(starts.select(F.col("id").alias("b"), *none))
    every = every.join(named.select(F.col("id").alias("b"), "component"), "b")
    # The links of a component from one number on; a row's links are all in the segment of its first one.
    placed = numbered(every, [F.col("component"), F.col("b"), F.col("a").asc_nulls_first()])
    first = placed.groupBy("component").agg(F.min("number").alias("first"))
    own = placed.groupBy("component", "b").agg(F.min("number").alias("own"))
    part = F.floor((F.col("own") - F.col("first")) / (segment or SEGMENT)).cast("bigint")
    parted = own.join(first, "component").select("b", part.alias("part"))
    placed = cut(placed.join(parted, "b").select("component", "part", "b", "a", *others))
    last = placed.agg(F.max("part")).collect()[0][0]  # one number

    def of_segment(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["b", "a"], na_position="first")
        values = [[None if pd.isna(v) else v for v in rows[c].tolist()] for c in ("b", "a", *others, "_state")]
        *asked, states = values
        known = {a: s for a, s in zip(asked[1], states, strict=True) if s is not None}
        found = decide(list(zip(*asked, strict=True)), known)
        return pd.DataFrame({"id": list(found), "state": list(found.values())})

    settled = links.select(F.col("b").alias("id"), F.lit(None).cast(state).alias("state")).limit(0)
    for k in range((last + 1) if last is not None else 0):
        now = placed.where(F.col("part") == k)
        known = settled.select(F.col("id").alias("a"), F.col("state").alias("_state"))
        found = now.join(known, "a", "left") if k else now.withColumn("_state", F.lit(None).cast(state))
        found = cut(found.groupBy("component").applyInPandas(of_segment, f"id {kind}, state {state}"))
        settled = cut(settled.join(found, "id", "left_anti").unionByName(found)) if k else found
    return settled


def first_come(links: DataFrame, a: str, b: str, segment: int | None = None) -> DataFrame:
    """(id, stays) for every end of a link, `a` being earlier than `b`: in order, a row stays if no row that stays links to it."""

    def decide(rows: list[tuple], known: dict) -> dict:
        stays: dict = {}
        for b, a in rows:
            stays[b] = stays.get(b, True) and not (a is not None and stays.get(a, known.get(a, False)))
        return stays

    ends = cut(links.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    gone, left, unsettled = _without_losers(ends)
    if unsettled:
        gone = gone.unionByName(settle(left, decide, "boolean", segment).where("NOT state").select("id"))
    every = ends.select(F.col("a").alias("id")).unionByName(ends.select(F.col("b").alias("id"))).distinct()
    return every.join(gone.select("id", F.lit(False).alias("stays")), "id", "left").select("id", F.coalesce("stays", F.lit(True)).alias("stays"))


def _without_losers(links: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(rows that go, links that are left, their number), where all rows at once leave few.

    A row that no link leads to stays, so those it links to go, and their links with them. Where links are many to a row, such a
    round takes most of them away; rounds go on until none is left, or until one leaves more than half, as in a chain.
    """
    gone, left, n = links.select(F.col("b").alias("id")).limit(0), links, links.count()
    while n:
        stay = left.select("a").distinct().join(left.select(F.col("b").alias("a")), "a", "left_anti")
        now = cut(left.join(stay, "a", "left_semi").select(F.col("b").alias("id")).distinct())
        gone = gone.unionByName(now)
        left = cut(left.join(now.withColumnRenamed("id", "a"), "a", "left_anti").join(now.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b"))
        before, n = n, left.count()
        if n * 2 > before:
            break
    return gone, left, n


def folded(links: DataFrame, segment: int | None = None) -> DataFrame:
    """(id, slot): where each row of a linked group stands, -1 for one that has folded into another.

    `links` has a, b, a_dead, b_dead and ratio. In order, a row folds into the most alike row that stands, of equals the
    one whose place is earliest, or else takes a place of its own. A dead row gives its place to a live one that folds into it.
    """

    def decide(rows: list[tuple], known: dict) -> dict:
        slots = dict(known)
        dead: dict = {}
        near: dict = {}
        for b, a, a_dead, b_dead, ratio in rows:
            offers = near.setdefault(b, [])
            if a is not None:
                offers.append((ratio, a))
                dead[a], dead[b] = a_dead, b_dead
        out: dict = {}
        for b, offers in near.items():
            standing = [(ratio, -slots[a], a) for ratio, a in offers if slots.get(a, -1) >= 0]
            if not standing:
                slots[b] = out[b] = b
                continue
            _, slot, a = max(standing)
            slots[b] = out[b] = -1
            if dead[a] and not dead[b]:
                slots[b] = out[b] = -slot
                slots[a] = out[a] = -1
        return out

    kind = links.schema["b"].dataType.simpleString()
    return settle(links.select("a", "b", "a_dead", "b_dead", "ratio"), decide, kind, segment).withColumnRenamed("state", "slot")
