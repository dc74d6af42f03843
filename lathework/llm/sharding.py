"""Sharding by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split.

The key's hash has 60 bits. A bucket at depth d is a d-bit prefix; it splits on the next bit while it holds more bytes
than the limit. Bytes under a prefix only fall as it grows, so a row's bucket is the shortest prefix of its hash that
fits, and the whole directory comes from byte sums: one aggregation over all rows at a start depth, then one more over
the rows of the buckets still oversized, some bits deeper, until none is left or the bits end. Only sums travel.

Defined cases: a null key hashes as the empty string; null text has no bytes; an empty table has an empty directory;
rows with the same key share all bits, so a bucket of one key that exceeds the limit ends at the last bit and is marked
`fits = false`, as is a single row over the limit; other columns are carried along, but for those of
the names of added columns, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.llm.common import free_name, written

BITS = 60
#: Bits that one round of splitting looks ahead.
STEP = 4
DEFAULT_LIMIT = 4 << 20
#: Columns that a row gets.
ADDED = ("shard", "shard_depth", "shard_bytes", "shard_fits")


def key_hash(key: Column) -> Column:
    """The first 60 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("bigint")


def _prefix(h: Column, depth: Column | int) -> Column:
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def directory(docs: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """Buckets (depth, prefix, bytes, n_rows, fits) that cover every row once.

    Sums by prefix are small against the rows, and each round's sums come from the rows of oversized buckets alone.
    """
    sized = docs.select(key_hash(F.col(key)).alias("h"), size.cast("bigint").alias("bytes"))
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    at = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + STEP))
    # Levels 0..at of the directory from the sums at depth `at`.
    leaves = written(sized.groupBy(_prefix(F.col("h"), at).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n_rows")), "shard-sums")
    found, base = [], 0
    while True:
        levels = None
        for d in range(base, at + 1):
            level = leaves.groupBy(F.lit(d).alias("depth"), F.shiftright("prefix", at - d).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows"))
            levels = level if levels is None else levels.unionByName(level)
        last = at == BITS
        levels = levels.withColumn("fits", F.col("bytes") <= limit)
        # The parent must be oversized; the root has none. At the last bit nothing splits.
        parents = levels.where(~F.col("fits")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        child = levels.withColumn("parent", F.shiftright("prefix", 1)).join(parents, ["depth", "parent"], "left_semi")
        root = levels.where((F.col("depth") == base) & F.lit(base == 0)).withColumn("parent", F.lit(0).cast("bigint"))
        reached = written(child.unionByName(root.select(*child.columns)), "shard-levels")
        found.append(reached.where(F.col("fits") | F.lit(last) & (F.col("depth") == at)).select("depth", "prefix", "bytes", "n_rows", "fits"))
        over = reached.where(~F.col("fits") & (F.col("depth") == at)).select("prefix")
        if last or over.isEmpty():
            break
        base, at, before = at, min(BITS, at + STEP), at
        deeper = sized.withColumn("prefix", _prefix(F.col("h"), before)).join(over, "prefix", "left_semi")
        leaves = written(deeper.groupBy(_prefix(F.col("h"), at).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n_rows")), "shard-sums")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return written(out, "shard-directory")


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = DEFAULT_LIMIT) -> DataFrame:
    """`docs` with shard_depth, shard (the prefix bits as a string), shard_bytes and shard_fits.

    A row meets the directory once, at the depth that most buckets have: deeper ones stand under their prefix there, less
    deep ones under each that they cover, and of those a row's hash lies in the range of one. So a row moves once at most,
    whatever the number of depths. The join is by Spark's own choice of strategy and is never forced to be broadcast.
    """
    docs = docs.drop(*ADDED)
    buckets = directory(docs, key, F.octet_length(F.coalesce(F.col(text), F.lit(""))), limit)
    depths = buckets.groupBy("depth").agg(F.count("*").alias("n")).collect()  # at most 61 rows
    if not depths:
        return docs.select("*", F.lit("").alias("shard"), F.lit(0).alias("shard_depth"), F.lit(0).cast("bigint").alias("shard_bytes"), F.lit(True).alias("shard_fits"))
    usual = max(depths, key=lambda r: (r.n, r.depth)).depth
    own, home, low, high = (free_name(docs, n) for n in ("own_hash", "home", "low", "high"))
    rows = docs.withColumn(own, key_hash(F.col(key))).withColumn(home, _prefix(F.col(own), usual))
    left = lambda v, n: F.call_function("shiftleft", v, n.cast("int"))
    first = left(F.col("prefix"), F.greatest(usual - F.col("depth"), F.lit(0)))
    last = left(F.col("prefix") + 1, F.greatest(usual - F.col("depth"), F.lit(0))) - 1
    homes = F.when(F.col("depth") >= usual, F.array(F.call_function("shiftright", F.col("prefix"), F.greatest(F.col("depth") - usual, F.lit(0)).cast("int")))).otherwise(F.sequence(first, last))
    shards = buckets.select(
        F.explode(homes).alias(home),
        left(F.col("prefix"), BITS - F.col("depth")).alias(low),
        (left(F.col("prefix") + 1, BITS - F.col("depth")) - 1).alias(high),
        F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0"))).alias("shard"),
        F.col("depth").alias("shard_depth"),
        F.col("bytes").alias("shard_bytes"),
        F.col("fits").alias("shard_fits"),
    )
    met = rows.join(shards, (rows[home] == shards[home]) & rows[own].between(shards[low], shards[high]))
    return met.select(*[rows[f"`{c}`"] for c in docs.columns], *[shards[c] for c in ADDED])


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = DEFAULT_LIMIT) -> None:
    """The rows as Parquet under shard=<bits>. A shard that fits is written by one task; one that can't be split, by as many as it has limits.

    Rows that are equal in all columns are written by one task.
    """
    rows = assign_shards(docs, key, text, limit)
    every = [F.col(f"`{c}`") for c in docs.columns if c not in ADDED]
    part = F.pmod(F.xxhash64(*every), F.ceil(F.col("shard_bytes") / limit).cast("bigint"))
    part = F.when(F.col("shard_fits"), F.lit(0).cast("bigint")).otherwise(part)
    rows.withColumn("shard", F.concat(F.lit("b"), "shard")).repartition(F.col("shard"), part).write.partitionBy("shard").parquet(path)
