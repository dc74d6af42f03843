"""Answers to questions out of an index of vectors: a predicate by words, the nearest rows, those due soon first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.operators import stories, vector

# Words of a question, and what they ask for.
SOURCE_WORDS = {"nipa": "nipa", "니파": "nipa", "kstartup": "kstartup", "k-startup": "kstartup", "케이스타트업": "kstartup", "기업마당": "bizinfo", "bizinfo": "bizinfo"}
SOON_WORDS = "임박 곧마감 마감예정 마감앞둔 이번주 긴급 d-day".split()


def predicate(question: str, words: dict[str, str] = SOURCE_WORDS, column: str = "source") -> Column | None:
    """What a question restricts `column` to: the value of the first of the words in it."""
    hit = next((v for k, v in words.items() if k in question.lower()), None)
    return None if hit is None else F.col(column) == hit


def wants_soon(question: str) -> bool:
    """Whether a question asks for what is due soon; that it names a deadline is not enough. Blanks don't matter."""
    return any(w in question.lower().replace(" ", "") for w in SOON_WORDS)


def retrieve(index: DataFrame, queries: DataFrame, key: str, embedding: str, k: int = 5, where: Column | None = None, least: int = 3) -> DataFrame:
    """(query_id, id, similarity, rank): the k nearest of those that `where` lets through.

    A query that finds fewer than `least` so is asked again without the predicate. Both are the same join in blocks, the
    second with the few queries that need it.
    """
    found = vector.nearest(index, queries, key, embedding, k, where)
    if where is None:
        return found
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("query_id")
    again = queries.join(enough, F.col(key) == F.col("query_id"), "left_anti")
    return found.join(enough, "query_id", "left_semi").unionByName(vector.nearest(index, again, key, embedding, k))


def due_soon(found: DataFrame, index: DataFrame, key: str, deadline: str, as_of: Column, limit: int = 5) -> DataFrame:
    """What was found, with `place`: two best, then what is due within a week, then the rest; what has passed is out."""
    held = index.select(F.col(key).alias("id"), F.col(deadline).alias("_deadline"))
    return stories.soonest_first(found.join(held, "id"), "query_id", "rank", F.datediff(F.col("_deadline"), as_of), limit=limit).drop("_deadline")


def all_of(*conditions: Column | None) -> Column | None:
    """The conditions that there are, together."""
    given = [c for c in conditions if c is not None]
    return reduce(Column.__and__, given) if given else None
