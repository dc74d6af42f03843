"""Monitoring of announcements as one lazy plan: what is new, what is due, and what the state becomes.

Nothing is written or sent here. The caller delivers `new` and `reminders`, then commits the changes for what arrived.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.functions import dates
from lathework.functions.titles import canon_title, compatible
from lathework.operators import filters, ranking, titles, verdicts
from lathework.operators.lineage import cut

ANNOUNCEMENT = "ord bigint, id string, source string, title string, category string, department string, deadline timestamp_ntz, posted_date timestamp_ntz"
INDEX = "key string, title string, deadline timestamp_ntz, d_day int, score double"
SEEN = "key string, canon string, score double, until timestamp_ntz"


@dataclass(frozen=True)
class Outcome:
    """Tables of one run. `part` of `judged`: new, below, unscored; `deferred` waits for the next run."""

    judged: DataFrame
    new: DataFrame
    reminders: DataFrame
    deferred: DataFrame
    reasons: DataFrame


def default_score(rows: DataFrame) -> DataFrame:
    """A score by the number of keywords, for when no judge is given."""
    return rows.withColumn("score", verdicts.keyword_score(F.concat_ws(" ", "title", "category")))


def monitor(rows: DataFrame, index: DataFrame, seen: DataFrame, as_of: Column, score: Callable[[DataFrame], DataFrame] = default_score, least: float = 0.6, most: int = 150) -> Outcome:
    """The plan: deduplicate, restore deadlines, filter, split by index, leave out known rejections, cap, score, remind.

    `most` is how many rows one run gives to the judge, the newest first; the rest is `deferred` and loses nothing.
    """
    day = as_of.cast("date")
    expired = F.col("deadline").cast("date") < day
    once = titles.deduplicate(rows, "title", "source", "ord", expired).withColumn("key", F.concat_ws("_", "source", "id"))
    held = index.select(F.col("key").alias("i_key"), F.col("deadline").alias("i_deadline"), F.col("d_day").alias("before"), F.col("score").alias("i_score"))
    known = once.join(held, F.col("key") == F.col("i_key"), "left").withColumn("deadline", F.coalesce("deadline", "i_deadline"))
    judged = cut(verdicts.with_verdict(filters.deadline_window(known, "deadline", "posted_date", day)))
    stays = judged.where("reason IS NULL")
    active = index.where((F.col("deadline").isNull() | (F.col("deadline").cast("date") >= day)) & (F.coalesce("title", F.lit("")) != ""))
    unknown = stays.where("i_key IS NULL")
    twins = titles.match_titles(unknown, "key", "title", active.withColumnsRenamed({"key": "m_key", "title": "m_title"}), "m_key", "m_title", "m_key").drop("ratio")
    fresh = unknown.join(twins, "key", "left_anti").withColumn("normal", compatible("title"))
    fresh = fresh.withColumn("canon", canon_title(F.col("title"), F.col("normal"))).drop("normal")
    rejected = seen.where(F.col("until") > as_of.cast("timestamp_ntz")).select("key", "canon").distinct()
    open_ = cut(fresh.join(rejected, ["key", "canon"], "left_anti"))
    taken = cut(ranking.top(open_, [F.col("posted_date").desc_nulls_last(), F.col("deadline").asc_nulls_last(), F.col("ord")], most))
    scored = cut(score(taken))
    part = F.when(F.col("score").isNull() | F.isnan("score"), "unscored").when(F.col("score") >= least, "new").otherwise("below")
    said = scored.withColumn("part", part)
    # What the index holds is reminded of, crawled again or not; of twins the stored one is.
    left = dates.days_until(F.coalesce("c_deadline", "deadline"), day)
    again = stays.where("i_key IS NOT NULL").select("key", F.col("deadline").alias("c_deadline"))
    due = index.where(F.coalesce("score", F.lit(0.0)) >= least).join(again, "key", "left").withColumn("days", left)
    crossed = due.where(ranking.milestones(F.col("days"), F.coalesce("d_day", F.lit(-1)))).withColumn("order", F.col("days") * F.lit(1 << 50) + F.pmod(F.xxhash64("key"), F.lit(1 << 50)))
    reminders = titles.deduplicate(crossed, "title", None, "order", F.lit(False)).drop("order", "position")
    return Outcome(said, said.where("part = 'new'"), reminders, open_.join(taken.select("key"), "key", "left_anti"), filters.reason_counts(judged, F.col("reason"), verdicts.REASONS))


def index_changes(new: DataFrame, as_of: Column) -> DataFrame:
    """Rows of the index for what was delivered."""
    return new.select("key", "title", "deadline", dates.days_until(F.col("deadline"), as_of).alias("d_day"), "score")


def seen_changes(judged: DataFrame, as_of: Column) -> DataFrame:
    """Rows of the cache of rejections: scored and below the threshold, with their expiry. Unscored rows are tried again."""
    until = dates.cache_expiry(as_of, F.col("key"), F.col("deadline")).cast("timestamp_ntz")
    return judged.where("part = 'below'").select("key", "canon", "score", until.alias("until"))
