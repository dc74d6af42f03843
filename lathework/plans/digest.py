"""The digest of articles as one lazy plan: copies merged, history left out, judged, told stories dropped, capped.

Nothing is written or sent here. The caller sends `main` and `infra`, then commits `history_changes` of what arrived.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.functions.text import canonical_url, title_key
from lathework.operators import stories, verdicts
from lathework.operators.joins import without_any_key, without_unexpired
from lathework.operators.lineage import cut

ITEM = "ord bigint, gid string, title string, outlet string, region string, url string, snippet string, published_at timestamp, themes array<string>"
HISTORY, REJECTED, RECENT = "key string, at timestamp", "key string, until timestamp", "story string, at timestamp"


@dataclass(frozen=True)
class Digest:
    """`main` with `story` (the leading article's ord), `infra`, what waits (`later`), and what was judged out.

    `infra_over` is beyond the limit of its kind: it goes to the cache of rejections, as what is `rejected` does.
    """

    main: DataFrame
    infra: DataFrame
    infra_over: DataFrame
    later: DataFrame
    rejected: DataFrame


def default_judge(rows: DataFrame) -> DataFrame:
    """(outcome, score, theme) by rules, for when no judge is given."""
    return rows.withColumn("_v", verdicts.triage(F.col("title"), F.col("snippet"))).select(*rows.columns, "_v.outcome", "_v.score", "_v.theme")


def default_stories(rows: DataFrame) -> DataFrame:
    """`said`: the first article of the same normalised title and region, for when no one tells which are one story."""
    first = rows.groupBy(title_key(F.col("title")).alias("_t"), F.col("region").alias("_r")).agg(F.min("ord").alias("said"))
    return rows.join(first, (title_key(F.col("title")) == F.col("_t")) & F.col("region").eqNullSafe(F.col("_r"))).drop("_t", "_r")


def digest(
    items: DataFrame, history: DataFrame, rejected: DataFrame, recent: DataFrame, now: Column, start: Column, judge: Callable[[DataFrame], DataFrame] = default_judge,
    same_story: Callable[[DataFrame], DataFrame] = default_stories, stories_most: int = 20, infra_most: int = 10,
) -> Digest:
    """The plan. `stories_most` stories and `infra_most` further articles go out in one run; the rest of the stories waits.

    An article has three keys: its outlet and title, its id, its address; one of them in the history is enough to leave it
    out. A story whose title was sent lately goes as a whole if half of its articles say so.
    """
    timely = items.where(verdicts.in_window(F.col("published_at"), start, now) & ~F.col("title").rlike(verdicts.EMPTY_TITLE))
    keyed = timely.withColumn("k_title", F.concat_ws("|", "outlet", title_key(F.col("title")))).withColumn("k_url", canonical_url(F.col("url")))
    once = stories.by_canonical_url(stories.merge_copies(keyed, "ord", ["gid", "k_title"], ["themes"], ["snippet"]), F.col("k_url"), "ord")
    keys = F.array_compact(F.array(F.concat(F.lit("title:"), "k_title"), F.concat(F.lit("gid:"), "gid"), F.concat(F.lit("url:"), "k_url")))
    fresh = without_any_key(once.withColumn("keys", keys), "ord", "keys", history, "key")
    open_ = without_unexpired(fresh.withColumn("key", F.coalesce("gid", "k_title")), rejected, "key", "until", now)
    judged = cut(judge(open_))
    main = judged.where("outcome = 'main'")
    numbered = cut(stories.story_numbers(same_story(main), "ord", "said", "region").drop("said"))
    told = recent.select(F.col("story").alias("_told")).distinct()
    flagged = numbered.join(told, title_key(F.col("title")) == F.col("_told"), "left")
    votes = flagged.groupBy("story").agg(F.count_if(F.col("_told").isNotNull()).alias("hits"), F.count("*").alias("n"))
    untold = numbered.join(votes.where("hits > 0 AND 2 * hits >= n").select("story"), "story", "left_anti")
    rank = [-F.coalesce("score", F.lit(0.0)), -F.unix_micros("published_at"), F.col("ord")]
    chosen = cut(stories.top_stories(untold, "story", rank, stories_most))
    infra = cut(judged.where("outcome = 'infra'").orderBy(F.col("published_at").desc(), "ord").limit(infra_most))
    later = untold.join(chosen.select("ord"), "ord", "left_anti")
    over = judged.where("outcome = 'infra'").join(infra.select("ord"), "ord", "left_anti")
    return Digest(chosen, infra, over, later, judged.where("outcome = 'rejected'"))


def history_changes(sent: DataFrame, now: Column) -> DataFrame:
    """(key, at) for every key of what was delivered."""
    return sent.select(F.explode("keys").alias("key"), now.alias("at"))


def recent_changes(sent: DataFrame, now: Column) -> DataFrame:
    """(story, at): titles of what was delivered, which later articles are compared with."""
    return sent.select(title_key(F.col("title")).alias("story"), now.alias("at")).distinct()
