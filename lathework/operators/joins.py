"""Joins against an index, a history and earlier snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def new_only(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Rows whose key the index doesn't have; a null key is new."""
    return rows.join(index.select(key).distinct(), key, "left_anti")


def split_by_index(rows: DataFrame, index: DataFrame, key: str, score: str, least: float) -> DataFrame:
    """`rows` with `part`: stored, below (stored with a score under `least`) or fresh (not in the index)."""
    held = index.select(F.col(key).alias("i_key"), F.col(score).alias("i_score"))
    part = F.when(F.col("i_key").isNull(), "fresh").when(F.col("i_score") >= least, "stored").otherwise("below")
    return rows.join(held, F.col(key) == F.col("i_key"), "left").select(*rows.columns, part.alias("part"))


def restored(rows: DataFrame, index: DataFrame, key: str, column: str) -> DataFrame:
    """`rows` with nulls of `column` filled from the index."""
    held = index.select(F.col(key).alias("i_key"), F.col(column).alias("i_value"))
    joined = rows.join(held, F.col(key) == F.col("i_key"), "left")
    return joined.select(*[F.coalesce(column, "i_value").alias(column) if c == column else F.col(c) for c in rows.columns])


def without_any_key(rows: DataFrame, row_id: str, keys: str, history: DataFrame, key: str) -> DataFrame:
    """Rows of which no key of the array `keys` is in the history."""
    hit = rows.select(row_id, F.explode(keys).alias("k")).join(history.select(F.col(key).alias("k")).distinct(), "k", "left_semi").select(row_id).distinct()
    return rows.join(hit, row_id, "left_anti")


def without_unexpired(rows: DataFrame, cache: DataFrame, key: str, until: str, now: Column) -> DataFrame:
    """Rows that no unexpired entry of the cache rejects."""
    return rows.join(cache.where(F.col(until) > now).select(key).distinct(), key, "left_anti")


def changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change, old, new) between two snapshots: added, removed or updated."""
    a = before.select(F.col(key).alias("a_key"), F.col(value).alias("old"))
    b = after.select(F.col(key).alias("b_key"), F.col(value).alias("new"))
    both = a.join(b, F.col("a_key") == F.col("b_key"), "full")
    change = F.when(F.col("a_key").isNull(), "added").when(F.col("b_key").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "updated")
    return both.select(F.coalesce("a_key", "b_key").alias(key), change.alias("change"), "old", "new").where(F.col("change").isNotNull())
