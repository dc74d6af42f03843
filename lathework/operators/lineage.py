"""Cutting of lineage in iterations, and components by such an iteration."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(rows: DataFrame) -> DataFrame:
    """`rows` without their lineage, stored where all executors can read them."""
    spark = rows.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return rows.checkpoint()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) for every end of an edge, a component being named by its smallest id.

    Each round takes the smallest name among neighbours and then that name's own name, so names travel ever farther; long
    chains take a number of rounds that grows with the logarithm of their length in practice.
    """
    both = cut(edges.select(F.col(a).alias("id"), F.col(b).alias("n")).unionByName(edges.select(F.col(b).alias("id"), F.col(a).alias("n"))).distinct())
    names = cut(both.groupBy("id").agg(F.least(F.min("n"), F.first("id")).alias("component")))
    while True:
        offered = both.join(names.select(F.col("id").alias("n"), "component"), "n").groupBy("id").agg(F.min("component").alias("offer"))
        nearer = names.join(offered, "id").select("id", "component", F.least("component", "offer").alias("next"))
        ahead = names.select(F.col("id").alias("next"), F.col("component").alias("jump"))
        moved = cut(nearer.join(ahead, "next").select("id", "component", F.least("next", "jump").alias("next")))
        names = moved.select("id", F.col("next").alias("component"))
        if moved.where("next <> component").isEmpty():
            return names

