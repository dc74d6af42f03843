"""Nearest vectors of a query set by cosine, in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.functions.numbers import dot, norm
from lathework.operators.ranking import quota

#: Blocks that queries and rows are dealt into; a task compares one block of each.
BLOCKS = 8


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, where: Column | None = None, blocks: int = BLOCKS) -> DataFrame:
    """(query_id, id, similarity, rank): for each query the k nearest other rows, of those that `where` lets through.

    Queries have the columns of rows, with `q_` before each name. Every pair of blocks meets once by an equality join.
    """
    spread = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns]).withColumn("q_norm", norm(F.col(f"q_{vector}")))
    left = left.withColumn("qb", F.pmod(F.xxhash64(f"q_{key}"), F.lit(blocks)).cast("int")).withColumn("rb", spread)
    right = rows.withColumn("r_norm", norm(F.col(vector))).withColumn("rb", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn("qb", spread)
    pairs = left.join(right, ["qb", "rb"]).where(F.col(f"q_{key}") != F.col(key))
    pairs = pairs.where(where) if where is not None else pairs
    scored = pairs.select(F.col(f"q_{key}").alias("query_id"), F.col(key).alias("id"), (dot(F.col(f"q_{vector}"), F.col(vector)) / (F.col("q_norm") * F.col("r_norm"))).alias("similarity"))
    return quota(scored, ["query_id"], [F.col("similarity").desc(), F.col("id")], k)
