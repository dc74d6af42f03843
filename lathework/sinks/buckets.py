"""Keyed tables of hash buckets: an upsert writes the buckets it touches, a version refers to all others where they are.

A table is a folder. `data/v=<n>/_bucket=<k>` holds the rows of bucket k as version n left them, `manifest/v=<n>` tells for
each bucket in which version's data it is. A version counts once Spark has committed its manifest, which is written last;
readers take the newest one and its files, which no later version changes, so they see one version whole and a writer that
is lost leaves nothing that counts. What a batch costs follows the batch: its buckets are read and written, no others.

There is one writer at a time. The number of buckets is a table's own, from its first version on; `rebucket` changes it.
Rows with a null in the key or the version can't be placed: they are given back, and the rest is written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.operators.dedupe import last_of_key
from lathework.operators.lineage import cut
from lathework.sinks.tables import versions

#: Buckets of a new table; at some 100 MB for each, a table of 25 GB.
BUCKETS = 256
_MANIFEST = "bucket int, version int"


@dataclass(frozen=True)
class Written:
    """The version that a write made, how many buckets it wrote, and the rows it could not place."""

    version: int
    buckets: int
    failed: DataFrame


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[int, int]]:
    """A version, the newest if none is told, and its buckets; as many rows as the table has buckets."""
    known = versions(spark, f"{path}/manifest")
    if not known:
        return 0, {}
    version = known[-1] if version is None else version
    return version, {r.bucket: r.version for r in spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/v={version}").collect()}


def _of(spark: SparkSession, path: str, schema: str, placed: dict[int, int]) -> DataFrame:
    """The rows of some buckets; those that have never been written, in version 0, have none."""
    folders = [f"{path}/data/v={v}/_bucket={k}" for k, v in sorted(placed.items()) if v]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest if none is told; of no version, none."""
    return _of(spark, path.rstrip("/"), schema, _manifest(spark, path.rstrip("/"), version)[1])


def lookup(spark: SparkSession, path: str, schema: str, key: list[str], wanted: DataFrame) -> DataFrame:
    """The rows of the keys in `wanted`, out of the buckets that these keys are in."""
    path = path.rstrip("/")
    placed = _manifest(spark, path)[1]
    keys = wanted.select(*key).dropna().distinct()
    touched = [r[0] for r in keys.select(_bucket(key, max(1, len(placed)))).distinct().collect()]  # at most one a bucket
    return _of(spark, path, schema, {k: placed[k] for k in touched if k in placed}).join(keys, key, "left_semi")


def _commit(spark: SparkSession, path: str, version: int, rows: DataFrame, placed: dict[int, int]) -> None:
    rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/v={version}")
    spark.createDataFrame(sorted(placed.items()), _MANIFEST).coalesce(1).write.parquet(f"{path}/manifest/v={version}")


def upsert(rows: DataFrame, path: str, schema: str, key: list[str], version: list[str], buckets: int = BUCKETS) -> Written:
    """A new version in which each key has its row of the highest `version`; of a batch without rows there is none."""
    spark, path = rows.sparkSession, path.rstrip("/")
    now, placed = _manifest(spark, path)
    placed = placed or dict.fromkeys(range(buckets), 0)
    lacks = F.lit(False)
    for c in (*key, *version):
        lacks = lacks | F.col(c).isNull()
    batch = cut(rows.withColumn("_bucket", F.when(~lacks, _bucket(key, len(placed)))))
    failed, fit = batch.where("_bucket is null").drop("_bucket"), batch.where("_bucket is not null")
    touched = [r[0] for r in fit.select("_bucket").distinct().collect()]  # at most one a bucket
    if not touched:
        return Written(now, 0, failed)
    held = _of(spark, path, schema, {k: placed[k] for k in touched})
    names = held.columns
    merged = last_of_key(held.unionByName(fit.select(*names)), key, version)
    _commit(spark, path, now + 1, merged.withColumn("_bucket", _bucket(key, len(placed))), placed | dict.fromkeys(touched, now + 1))
    return Written(now + 1, len(touched), failed)


def delete(keys: DataFrame, path: str, schema: str, key: list[str]) -> Written:
    """A new version without the rows of some keys; those that were not there are given back."""
    spark, path = keys.sparkSession, path.rstrip("/")
    now, placed = _manifest(spark, path)
    gone = cut(keys.select(*key).dropna().distinct())
    touched = [r[0] for r in gone.select(_bucket(key, max(1, len(placed)))).distinct().collect() if placed.get(r[0])]  # at most one a bucket
    held = _of(spark, path, schema, {k: placed[k] for k in touched})
    failed = cut(gone.join(held, key, "left_anti"))
    if not touched:
        return Written(now, 0, failed)
    stay = held.join(gone, key, "left_anti").withColumn("_bucket", _bucket(key, len(placed)))
    left = {r[0] for r in stay.select("_bucket").distinct().collect()}  # at most one a bucket
    _commit(spark, path, now + 1, stay, placed | {k: now + 1 if k in left else 0 for k in touched})
    return Written(now + 1, len(touched), failed)


def rebucket(spark: SparkSession, path: str, schema: str, key: list[str], buckets: int) -> int:
    """A new version of the same rows in another number of buckets, the whole table written anew."""
    path = path.rstrip("/")
    now, placed = _manifest(spark, path)
    rows = _of(spark, path, schema, placed).withColumn("_bucket", _bucket(key, buckets))
    held = {r[0] for r in rows.select("_bucket").distinct().collect()}  # at most one a bucket
    _commit(spark, path, now + 1, rows, {k: now + 1 if k in held else 0 for k in range(buckets)})
    return now + 1


def forget(spark: SparkSession, path: str, keep: int) -> list[int]:
    """Deletes the manifests of all but the newest `keep` versions, and data that none of these refers to; the versions forgotten."""
    path = path.rstrip("/")
    known = versions(spark, f"{path}/manifest")
    old, kept = known[: len(known) - keep], known[len(known) - keep :]
    needed = {(v, k) for n in kept for k, v in _manifest(spark, path, n)[1].items()}
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = folder(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for n in old:
        for k, v in _manifest(spark, path, n)[1].items():
            if v and (v, k) not in needed:
                system.delete(folder(f"{path}/data/v={v}/_bucket={k}"), True)
    for n in old:
        system.delete(folder(f"{path}/manifest/v={n}"), True)
    return old
