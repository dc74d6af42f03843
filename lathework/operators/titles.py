"""Matching and deduplication of announcements by title: exact keys first, then cautious likeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.functions.titles import RATIO, comparable, likeness, with_title_parts
from lathework.operators.lineage import cut
from lathework.operators.sequence import folded


def alike_pairs(left: DataFrame, right: DataFrame, where: Column | None = None, least: float = RATIO) -> DataFrame:
    """The pairs of titles that are alike, with `ratio`.

    Both sides have a column `a` or `b`: a struct with `key` (of title_parts) and what else the caller wants to see.
    Candidates meet by the digits that both titles hold and a token of their signatures; a pair that shares several tokens
    is kept at the first alone, so no second shuffle removes repeats.
    """
    by = lambda rows, side: rows.select(side, F.col(f"{side}.key.bucket").alias("bucket"), F.explode(f"{side}.key.prefix").alias("token"))
    met = by(left, "a").join(by(right, "b"), ["bucket", "token"])
    met = met.where(F.array_intersect("a.key.prefix", "b.key.prefix")[0] == F.col("token"))
    met = met.where(comparable(F.col("a.key"), F.col("b.key"), least))
    met = met.where(where) if where is not None else met
    return met.select("a", "b", likeness(F.col("a.key"), F.col("b.key")).alias("ratio")).where(F.col("ratio") >= least)


def keyed(rows: DataFrame, title: str, into: str = "key", least: float = RATIO) -> DataFrame:
    """`rows` with the parts of their titles, which are taken apart once for each distinct title."""
    known = rows.select(F.col(title).alias("_known")).distinct()
    known = cut(with_title_parts(known, "_known", into, least))
    return rows.join(known.hint("merge"), F.col(title).eqNullSafe(F.col("_known"))).drop("_known")


def match_titles(rows: DataFrame, row_id: str, title: str, index: DataFrame, key: str, index_title: str, order: str) -> DataFrame:
    """(row_id, key, ratio) of the best entry of the index for each row that has one; ratio 1 for equal keys.

    Equal keys come first (the entry first in `order`), then the highest ratio, the shorter core, the order. Keys have to
    be unique in the index, and so has `order`. Empty and null titles match nothing.
    """
    wanted = keyed(rows.select(row_id, F.col(title).alias("_title")), "_title", "_parts")
    wanted = cut(wanted.select(row_id, F.struct(F.col(row_id).alias("id"), F.col("_parts").alias("key")).alias("b")).where("b.key.canon <> ''"))
    held = keyed(index.select(F.col(key).alias("id"), F.col(order).alias("order"), F.col(index_title).alias("_title")), "_title", "_parts")
    held = held.select(F.struct("id", "order", F.col("_parts").alias("key")).alias("a")).where("a.key.canon <> ''")
    # Of entries with one key and the same parts none but the first can be the best.
    held = cut(held.groupBy(F.struct("a.key.canon", "a.key.compact", "a.key.core", "a.key.words").alias("same")).agg(F.min_by("a", "a.order").alias("a")).select("a"))
    first = held.groupBy(F.col("a.key.canon").alias("canon")).agg(F.min_by("a.id", "a.order").alias(key))
    exact = wanted.join(first, F.col("b.key.canon") == F.col("canon")).select(row_id, key, F.lit(1.0).alias("ratio"))
    rest = wanted.join(first, F.col("b.key.canon") == F.col("canon"), "left_anti").select("b")
    rank = F.struct(-F.col("ratio"), F.length("a.key.core"), F.col("a.order"))
    near = alike_pairs(held, rest).groupBy(F.col("b.id").alias(row_id)).agg(F.min_by(F.struct(F.col("a.id").alias("id"), "ratio"), rank).alias("m"))
    return exact.unionByName(near.select(row_id, F.col("m.id").alias(key), F.col("m.ratio").alias("ratio")))


def deduplicate(rows: DataFrame, title: str, source: str | None, order: str, expired: Column) -> DataFrame:
    """`rows`, one for each programme, with `position`: where its first announcement stood in `order`, which is unique.

    Rows of one key fold into the first, then, in order, each row into the most alike kept row of another source (of any
    row, without a source). What is kept gives way to a later row if it has expired and that has not. The second pass
    depends on the order within linked rows alone, so it runs by bounded segments of linked groups.
    """
    told = rows.select(F.struct(*rows.columns).alias("row"), F.col(order).alias("at"), F.coalesce(expired, F.lit(False)).alias("dead"), F.col(title).alias("title"))
    told = keyed(told, "title").drop("title")
    same = F.when(F.col("key.canon") != "", F.col("key.canon")).otherwise(F.concat(F.lit(" "), F.col("at").cast("string")))
    first = told.groupBy(same.alias("same")).agg(F.min_by(F.struct("row", "dead", "key"), F.struct("dead", "at")).alias("kept"), F.min("at").alias("position"))
    kept = cut(first.select("position", "kept.*"))
    from_ = F.col(f"row.{source}") if source else F.col("position")
    side = F.struct(F.col("position").alias("id"), from_.alias("source"), "dead", "key")
    other = (F.col("a.source") != F.col("b.source")) & (F.col("a.id") < F.col("b.id"))
    pairs = cut(alike_pairs(kept.select(side.alias("a")), kept.select(side.alias("b")), other).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.dead").alias("a_dead"), F.col("b.dead").alias("b_dead"), "ratio"))
    if pairs.isEmpty():
        return kept.select("row.*", "position")
    placed = kept.join(folded(pairs).withColumnRenamed("id", "position"), "position", "left")
    return placed.where("slot is null or slot >= 0").select("row.*", F.coalesce("slot", "position").alias("position"))

