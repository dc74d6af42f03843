"""Keyed tables in folders, written whole as a new version, so that a reader or a lost executor never sees half of one.

Versions are subfolders `v=n`; one counts once Spark has committed it. Folders are listed through Spark's file systems, so
any store will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.operators.dedupe import last_of_key

#: How long what was sent, rejected, resolved or shown lately is remembered, in days.
KEPT_DAYS = {"sent": 45, "judged": 10, "decoded": 30, "recent": 5}


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions of a table, oldest first."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/v=*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(f.getPath().getParent().getName().removeprefix("v=")) for f in found or [])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, through Spark's file systems."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest version; an empty table if there is none. The schema is told, never guessed."""
    known = versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/v={known[-1]}") if known else spark.createDataFrame([], schema)


def write(rows: DataFrame, path: str) -> int:
    """Writes a new version and returns its number; older ones stay until the caller removes them."""
    number = (versions(rows.sparkSession, path) or [0])[-1] + 1
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/v={number}")
    return number


def upsert(rows: DataFrame, path: str, schema: str, key: list[str], version: list[str]) -> int:
    """A new version in which each key has its row of the highest `version`; null keys are rows of one key."""
    held = read(rows.sparkSession, path, schema)
    return write(last_of_key(held.unionByName(rows.select(*held.columns)), key, version), path)


def pruned(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows no older than `days`; rows without a time go."""
    return rows.where(F.col(at) >= now - F.make_interval(days=F.lit(days)))


def save_snapshot(rows: DataFrame, path: str, stamp: str) -> None:
    """One snapshot under its time stamp, parted by source."""
    rows.withColumn("stamp", F.lit(stamp)).write.mode("append").partitionBy("source", "stamp").parquet(path)


def latest_snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Each source's newest snapshot. Only the parts that are newest are read: the stamps come from the folders' names."""
    rows = spark.read.schema(f"{schema}, source string, stamp string").parquet(path)
    newest = rows.groupBy("source").agg(F.max("stamp").alias("stamp"))
    return rows.join(newest, ["source", "stamp"], "left_semi")


def cache_changes(judged: DataFrame, least: float, now: Column) -> DataFrame:
    """(key, change, score) to a cache of rejections after a run: what passed leaves it, what was scored lower enters it.

    What expired meanwhile enters with a score of 0; rows without a score change nothing and are tried again.
    """
    change = F.when(F.col("deadline") < now, "record").when(F.col("score") >= least, "discard").when(F.col("score").isNotNull(), "record")
    score = F.when(F.col("deadline") < now, 0.0).otherwise(F.col("score"))
    return judged.select("key", change.alias("change"), score.alias("score")).where("change IS NOT NULL")
