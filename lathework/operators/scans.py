"""Scans of several sources: their health, quotas, order, stop rules, and caches of what is known of an entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def source_health(rows: DataFrame, source: str, sources: DataFrame, errors: DataFrame) -> DataFrame:
    """(source, n, state) of every source listed in `sources`: failed, empty or fine; a failed one isn't called empty.

    `errors` has a row for each failure of a source. Rows of sources that aren't listed are left out.
    """
    counted = rows.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    failed = errors.select("source").distinct().withColumn("failed", F.lit(True))
    joined = sources.select("source").join(counted, "source", "left").join(failed, "source", "left")
    state = F.when(F.coalesce("failed", F.lit(False)), "failed").when(F.coalesce("n", F.lit(0)) == 0, "empty").otherwise("fine")
    return joined.select("source", F.coalesce("n", F.lit(0)).alias("n"), state.alias("state"))


def announced(rows: DataFrame, entry: str, feed: str, kind: Column, kinds: list[str]) -> DataFrame:
    """Entries announced as one of `kinds`, each once, from the first of its feeds; a missing kind counts as new."""
    wanted = rows.where(F.coalesce(kind, F.lit("new")).isin(*kinds))
    return wanted.groupBy(entry).agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns if c != entry]), F.col(feed)).alias("first")).select(entry, "first.*")


def first_then_best(rows: DataFrame, lists: str, place: str, entry: str, fits: Column, score: str, each: int, most: int) -> DataFrame:
    """The first `most` fitting entries of several ranked lists, one list after the other, each list to its place `each`, best first.

    An entry counts where it stands first. The limit is applied before the order by score; `rank` is the place in that order.
    """
    once = rows.where(F.col(place) <= each).groupBy(entry, score).agg(F.min(F.struct(lists, place)).alias("at"), F.max(fits).alias("fits")).where("fits")
    # At most lists * each rows are left here, whatever the input.
    first = once.withColumn("nth", F.row_number().over(Window.orderBy("at"))).where(F.col("nth") <= most)
    return first.select(entry, score, F.row_number().over(Window.orderBy(F.col(score).desc(), "nth")).alias("rank"))


def until_nothing_new(rows: DataFrame, source: str, page: str, entry: str) -> DataFrame:
    """Rows of each source's pages before the first page on which every entry has stood on an earlier one, each entry once."""
    seen = rows.groupBy(source, entry).agg(F.min(page).alias("first"))
    news = seen.groupBy(source, F.col("first").alias("p")).agg(F.count("*").alias("n"))
    pages = rows.select(source, F.col(page).alias("p")).distinct().join(news, [source, "p"], "left")
    stops = pages.where("n IS NULL").groupBy(source).agg(F.min("p").alias("stop"))
    return seen.join(stops, source, "left").where(F.col("stop").isNull() | (F.col("first") < F.col("stop"))).select(source, entry, F.col("first").alias(page))


def board_quota(rows: DataFrame, board: str, order: list[Column], most: int, boards: int) -> DataFrame:
    """Each board's share of `most` rows, the same for all `boards`, one at least."""
    window = Window.partitionBy(board).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(window)).where(F.col("nth") <= max(1, most // boards)).drop("nth")


def without_skipped(rows: DataFrame, category: str, title: str, categories: list[str], words: list[str]) -> DataFrame:
    """Rows of no skipped category, and with no skipped word in the title."""
    held = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.coalesce(F.col(title), F.lit("")), w))
    return rows.where(~F.coalesce(F.col(category).isin(*categories), F.lit(False)) & ~held)


def resolved(rows: DataFrame, entry: str, cache: DataFrame, as_of: Column) -> DataFrame:
    """`rows` with `url` from a cache of (id, url, until) where it is known and has not run out, null elsewhere."""
    held = cache.where(F.col("until") >= as_of).groupBy(F.col("id").alias("c_id")).agg(F.max_by("url", "until").alias("url"))
    return rows.join(held, F.col(entry) == F.col("c_id"), "left").drop("c_id")


def cache_update(cache: DataFrame, found: DataFrame, as_of: Column, days: int) -> DataFrame:
    """(id, url, until): new and changed addresses get a new time, unchanged ones keep theirs, run-out ones go."""
    now = found.groupBy("id").agg(F.max("url").alias("new_url"))
    held = cache.where(F.col("until") >= as_of)
    both = held.join(now, "id", "full")
    changed = F.col("new_url").isNotNull() & ~F.col("new_url").eqNullSafe(F.col("url"))
    return both.select("id", F.coalesce("new_url", "url").alias("url"), F.when(changed, F.date_add(as_of, days)).otherwise(F.col("until")).alias("until"))


def distinct_in_order(rows: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """A row for each value of a group with its place in the order of first appearance."""
    first = rows.groupBy(*group, value).agg(F.min(order).alias("first"))
    return first.select(*group, value, F.row_number().over(Window.partitionBy(*group).orderBy("first", value)).alias("place"))
