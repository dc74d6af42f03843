"""Removal of repeats: by key with priorities, by votes, and by likeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.operators import characters
from lathework.operators.lineage import cut
from lathework.operators.sequence import first_come
from lathework.operators.titles import alike_pairs, keyed


def best_of_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by `order`, which has to tell all rows apart.

    It is an aggregation with a partial step on each side of the shuffle, so a key with many rows is no single task's.
    """
    names = [f"o{i}" for i in range(len(order))]
    return _extreme(rows, key, F.struct(*[c.alias(n) for c, n in zip(order, names, strict=True)], F.struct(*rows.columns).alias("row")), F.min)


def last_of_key(rows: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """One row per key: that of the highest version, as an upsert leaves it."""
    return _extreme(rows, key, F.struct(*[F.col(v).alias(f"o{i}") for i, v in enumerate(version)], F.struct(*rows.columns).alias("row")), F.max)


def _extreme(rows: DataFrame, key: list[str], ranked: Column, pick) -> DataFrame:
    return rows.groupBy(*[F.col(k).alias(f"k_{k}") for k in key]).agg(pick(ranked).alias("r")).select("r.row.*")


def live_first(rows: DataFrame, key: list[str], expired: Column, order: list[Column]) -> DataFrame:
    """One row per key: the first that has not expired, else the first of all."""
    return best_of_key(rows, key, [expired.cast("int"), *order])


def drop_by_majority(rows: DataFrame, group: str, flagged: Column) -> DataFrame:
    """Without the groups in which half or more of the rows are flagged."""
    votes = rows.groupBy(F.col(group).alias("g")).agg(F.count_if(flagged).alias("hits"), F.count("*").alias("n")).where(F.col("hits") * 2 >= F.col("n"))
    return rows.join(votes.where("hits > 0"), F.col(group).eqNullSafe(F.col("g")), "left_anti")


def greedy_alike(rows: DataFrame, row_id: str, title: str, source: str, least: float = 0.9) -> DataFrame:
    """In order of `row_id`, the first row of each title, less those that are alike to a kept row of another source.

    Titles are told apart and compared as by `titles.alike_pairs`: all that can be alike meet, by their numbers and by
    pairs of letters. The order is settled over the links by segments, so no group of alike titles meets in one task. Rows
    whose title is empty or null stay all.
    """
    named = rows.select(F.col(row_id).alias("id"), F.col(source).alias("source"), F.col(title).alias("title"))
    told = cut(keyed(named, "title", least=least).drop("title"))
    first = told.where("key.canon <> ''").groupBy("key.canon").agg(F.min_by(F.struct("id", "source", "key"), "id").alias("side"))
    side = cut(first.select("side"))
    other = (F.col("a.source") != F.col("b.source")) & (F.col("a.id") < F.col("b.id"))
    pairs = cut(alike_pairs(side.select(F.col("side").alias("a")), side.select(F.col("side").alias("b")), other, least).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")))
    gone = first_come(pairs, "a", "b").where("NOT stays").select("id")
    stay = side.select("side.id").join(gone, "id", "left_anti").union(told.where("key.canon = ''").select("id"))
    return rows.join(stay.withColumnRenamed("id", "kept_id"), F.col(row_id) == F.col("kept_id"), "left_semi")


def distinct_articles(rows: DataFrame, order: str, title: str, within: Column, least: float = 0.6) -> DataFrame:
    """In `order`, the first row of each title, less those of a group that are alike to an earlier row of the group that stays.

    Alike are titles with an in-order ratio of `least` or more, the earlier one first. `within` tells the rows of the group;
    all others are held against nothing but equal titles. Null titles are empty ones. `order` has to be unique.
    """
    told = rows.select(F.col(order).alias("id"), F.coalesce(F.col(title), F.lit("")).alias("title"), F.coalesce(within, F.lit(False)).alias("within"))
    first = cut(told.groupBy("title").agg(F.min_by(F.struct("id", "within"), "id").alias("f")).select("f.id", "title", "f.within"))
    pairs = characters.alike(first.where("within").select("id", "title"), "title", least)
    gone = first_come(pairs, "a", "b").where("NOT stays").select("id")
    stay = first.select("id").join(gone, "id", "left_anti").withColumnRenamed("id", "kept_id")
    return rows.join(stay, F.col(order) == F.col("kept_id"), "left_semi")
