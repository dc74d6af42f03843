"""An index of vectors by inverted lists, for searches by cosine that need not read all of it.

Centroids are fitted on a sample of at most SAMPLE rows, chosen by hash; every row is then put into the list of its nearest
centroid, with its angle to it. Angles obey the triangle inequality, so a row of a list whose rows lie within `widest` of
their centroid is no nearer to a query than the query's angle to the centroid less `widest`. A search reads a query's
nearest lists first, and, if it has to be exact, those others that could still hold a nearer row than the k found.

Columns have roles, kept in the schema's metadata: the key, the vector, those that predicates may name, which lie beside the
vectors, and all others, which lie apart and are joined to what was found only.

Defined cases: rows without a vector, or with one of length 0 or with nulls or NaN in it, have no direction: they are kept in
list -1 and never found, and such queries find nothing. Equal similarities go by id. An empty index gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathework.functions.numbers import norm
from lathework.operators.lineage import cut
from lathework.operators.ranking import quota

#: Rows that centroids are fitted on, at most.
SAMPLE = 1 << 15
#: Lists at most; a centroid is some numbers, so that all of them together are a few MB.
LISTS_MOST = 4096
#: Rows of a list that one task compares with a query; longer lists are parted.
PART = 1 << 16
#: Queries that a task compares with a part of a list at once, about; and cells of a matrix of similarities.
QUERIES, CELLS = 1 << 13, 1 << 22
#: Room for rounding between angles of a bound and similarities.
SLACK = 1e-6


@dataclass(frozen=True)
class Index:
    """`lists`: list, part, angle, key, vector and what predicates may name. `payload`: key and the rest. `centres`: one row a list."""

    lists: DataFrame
    payload: DataFrame
    centres: DataFrame
    key: str
    vector: str


def with_roles(rows: DataFrame, key: str, vector: str, filterable: list[str]) -> DataFrame:
    """`rows` with a `role` in the metadata of each column: key, vector, filterable or other."""
    role = {c: "filterable" if c in filterable else "other" for c in rows.columns} | {key: "key", vector: "vector"}
    return rows.select(*[F.col(c).alias(c, metadata={"role": role[c]}) for c in rows.columns])


def by_role(schema: T.StructType, role: str) -> list[str]:
    return [f.name for f in schema.fields if f.metadata.get("role") == role]


def predicate(schema: T.StructType, **equal: object) -> Column:
    """That columns have values, or one of a list of them; a column that is not filterable is refused."""
    allowed = by_role(schema, "filterable")
    out = F.lit(True)
    for name, value in equal.items():
        if name not in allowed:
            raise ValueError(f"{name} is not filterable; these are: {', '.join(allowed)}")
        out = out & (F.col(name).isin(value) if isinstance(value, list | tuple) else F.col(name).eqNullSafe(F.lit(value)))
    return out


def _directed(vector: str) -> Column:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return v.isNotNull() & ~bad & (norm(v) > 0)


def _unit(values: pd.Series | list) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in values])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _fit(sample: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centroids by spherical k-means, started from rows far from those chosen before."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(sample)))]
    far = np.maximum(1 - sample @ sample[chosen[0]], 0)
    while len(chosen) < lists and far.max() > 1e-12:
        chosen.append(int(rng.choice(len(sample), p=far / far.sum())))
        far = np.maximum(np.minimum(far, 1 - sample @ sample[chosen[-1]]), 0)
    centres = sample[chosen]
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


def build(rows: DataFrame, lists: int | None = None, rounds: int = 8, seed: int = 0) -> Index:
    """An index of `rows`, whose columns have roles; without `lists` there are about as many as the root of the rows.

    The lists are stored at once (see `lineage.cut`), so that a search does not assign the rows anew.
    """
    spark = rows.sparkSession
    (key,), (vector,) = by_role(rows.schema, "key"), by_role(rows.schema, "vector")
    filterable, other = by_role(rows.schema, "filterable"), by_role(rows.schema, "other")
    good = rows.where(_directed(vector))
    n = good.count()
    lists = min(lists or max(1, round(n**0.5)), LISTS_MOST)
    drawn = good.select(vector).orderBy(F.xxhash64(key), key).limit(SAMPLE).toPandas()[vector]  # at most SAMPLE rows
    centres = _fit(_unit(drawn), lists, rounds, seed) if len(drawn) else np.zeros((0, 1))
    sent = spark.sparkContext.broadcast(centres)  # at most LISTS_MOST vectors

    @F.pandas_udf("struct<list int, angle double>")
    def placed(vectors: pd.Series, directed: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"list": np.full(len(vectors), -1, np.int32), "angle": np.full(len(vectors), np.nan)})
        some = np.flatnonzero(directed.fillna(False).to_numpy(bool))
        if len(some):
            near = _unit(vectors.iloc[some]) @ sent.value.T
            best = near.argmax(axis=1)
            out.loc[some, "list"] = best.astype(np.int32)
            out.loc[some, "angle"] = np.arccos(np.clip(near[np.arange(len(some)), best], -1, 1))
        return out

    put = rows.select(key, vector, *filterable, placed(F.col(vector), _directed(vector)).alias("_at"))
    kept = cut(put.select(F.col("_at.list").alias("list"), F.col("_at.angle").alias("angle"), key, vector, *filterable))
    sizes = kept.where("list >= 0").groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("widest"))
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
    known = known.join(sizes, "list").withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    parts = F.broadcast(known.select("list", "parts"))  # a row a list
    kept = kept.join(parts, "list", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(F.lit("part"), F.col(key)), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    return Index(kept, rows.select(key, *other), known, key, vector)


def save(index: Index, path: str) -> None:
    """Writes the index: vectors in a folder for each list, the rest apart, sorted by key so that few parts of it are read."""
    path = path.rstrip("/")
    index.centres.write.mode("overwrite").parquet(f"{path}/centres")
    index.payload.orderBy(index.key).write.mode("overwrite").parquet(f"{path}/payload")
    index.lists.repartition("list", "part").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")


def load(spark: SparkSession, path: str) -> Index:
    """What `save` has written. Files hold the columns' roles, too."""
    path = path.rstrip("/")
    lists = spark.read.parquet(f"{path}/lists").withColumn("list", F.col("list").cast("int"))
    (key,), (vector,) = by_role(lists.schema, "key"), by_role(lists.schema, "vector")
    return Index(lists, spark.read.parquet(f"{path}/payload"), spark.read.parquet(f"{path}/centres"), key, vector)


def _ranked(queries: DataFrame, centres: DataFrame) -> DataFrame:
    """(query_id, q_vector, near): all lists for every query, the nearest first, as an array of (list, away).

    Centres are broadcast, at most LISTS_MOST of them, so there is no join without a key.
    """
    held = centres.orderBy("list").select("list", "centre").collect()  # at most LISTS_MOST rows
    lists = np.array([h[0] for h in held], np.int32)
    sent = queries.sparkSession.sparkContext.broadcast((lists, np.array([h[1] for h in held]).T))

    @F.pandas_udf("array<struct<list:int,away:double>>")
    def near(vectors: pd.Series) -> pd.Series:
        lists, centres = sent.value
        if not len(lists) or not len(vectors):
            return pd.Series([[] for _ in vectors])
        angles = np.arccos(np.clip(_unit(vectors) @ centres, -1, 1))
        order = np.argsort(angles, axis=1, kind="stable")
        return pd.Series([[{"list": int(lists[j]), "away": float(a[j])} for j in o] for a, o in zip(angles, order, strict=True)])

    return queries.withColumn("near", near("q_vector"))


def _ordered_dot(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The dots of rows with the same rows of others, summed in the order of `numbers.dot`, so with its rounding."""
    out = np.zeros(len(rows))
    for i in range(rows.shape[1]):
        out += rows[:, i] * others[:, i]
    return out


def _nearest(key: str, vector: str, k: int):
    """A function of the rows and the queries of one part of a list: (query_id, id, similarity) of each query's k nearest in it.

    Products of blocks tell which rows may be among the k; these alone get their similarity as `numbers.dot` has it.
    """

    def compare(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, asking = rows[key].to_numpy(zero_copy_only=False), asked["query_id"].to_numpy(zero_copy_only=False)
        out: list[list[np.ndarray]] = [[], [], []]
        if len(ids) and len(asking):
            held, wanted = _matrix(rows[vector]), _matrix(asked["q_vector"])
            held_norm, wanted_norm = np.sqrt(_ordered_dot(held, held)), np.sqrt(_ordered_dot(wanted, wanted))
            unit = (held / held_norm[:, None]).T
            step = max(1, CELLS // len(ids))
            for at in range(0, len(asking), step):
                near = (wanted[at : at + step] / wanted_norm[at : at + step, None]) @ unit
                near[asking[at : at + step, None] == ids[None, :]] = -np.inf
                least = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(near), -2.0)
                q, r = np.nonzero(near >= np.maximum(least - SLACK, -2.0)[:, None])
                # Of each query's rows in turn, as many copies of one vector may be in reach.
                for some in np.array_split(np.arange(len(q)), len(q) * held.shape[1] // CELLS + 1):
                    alike = _ordered_dot(wanted[at + q[some]], held[r[some]]) / (wanted_norm[at + q[some]] * held_norm[r[some]])
                    order = np.lexsort((ids[r[some]], -alike, q[some]))
                    sorted_q = q[some][order]
                    rank = np.arange(len(order)) - np.searchsorted(sorted_q, sorted_q)
                    best = order[rank < k]
                    for column, values in zip(out, (asking[at + q[some][best]], ids[r[some][best]], alike[best]), strict=True):
                        column.append(values)
        made = [np.concatenate(c) if c else np.array([]) for c in out]
        kinds = [asked.schema.field("query_id").type, rows.schema.field(key).type, pa.float64()]
        return pa.table([pa.array(m).cast(t) for m, t in zip(made, kinds, strict=True)], ["query_id", "id", "similarity"])

    return compare


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _compared(index: Index, asked: DataFrame, k: int, where: Column | None) -> DataFrame:
    """(query_id, id, similarity) of the k nearest within the lists asked for, long lists part by part, many queries in shares."""
    parts = F.broadcast(index.centres.select("list", "parts"))
    asked = asked.select("query_id", "q_vector", "list").join(parts, "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    counted = asked.groupBy("list", "part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("shares"))
    rows = index.lists.where("list >= 0")
    rows = (rows.where(where) if where is not None else rows).select("list", "part", index.key, index.vector)
    rows = rows.join(F.broadcast(counted), ["list", "part"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    asked = asked.join(F.broadcast(counted), ["list", "part"]).withColumn("share", F.pmod(F.xxhash64(F.lit("share"), "query_id"), F.col("shares")).cast("int")).drop("shares")
    by = ["list", "part", "share"]
    key, kind = index.key, index.lists.schema
    met = rows.groupBy(*by).cogroup(asked.groupBy(*by))
    found = met.applyInArrow(_nearest(key, index.vector, k), f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {kind[key].dataType.simpleString()}, similarity double")
    return quota(found, ["query_id"], [F.col("similarity").desc(), F.col("id")], k).drop("rank")


def search(index: Index, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, where: Column | None = None, payload: bool = False) -> DataFrame:
    """(query_id, id, similarity, rank): for each row of `queries` the k nearest others in its `probes` nearest lists.

    `queries` has the index's key and vector. An exact search then also reads all lists that by their bounds could hold a
    nearer row, or any if fewer than k were found, and so returns what a comparison with all rows would. What a search that is
    not exact finds depends on the data: `probes_for` measures how many lists it takes. `where` is made by `predicate`. With `payload` the other columns of what was found are joined.
    """
    asked = queries.where(_directed(index.vector)).select(F.col(index.key).alias("query_id"), F.col(index.vector).alias("q_vector"))
    ranked = _ranked(asked, index.centres)
    first = ranked.select("query_id", "q_vector", F.inline(F.slice("near", 1, probes)))
    found = _compared(index, first, k, where)
    if exact:
        worst = found.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("similarity").alias("_least"))
        wide = F.broadcast(index.centres.select("list", "widest"))
        rest = ranked.join(worst, "query_id", "left").select("query_id", "q_vector", "_n", "_least", F.inline(F.slice("near", probes + 1, LISTS_MOST)))
        bound = F.cos(F.greatest(F.lit(0.0), F.col("away") - F.col("widest"))) + SLACK
        more = rest.join(wide, "list").where((F.coalesce("_n", F.lit(0)) < k) | (bound >= F.col("_least")))
        both = found.unionByName(_compared(index, more, k, where))
        found = quota(both, ["query_id"], [F.col("similarity").desc(), F.col("id")], k).drop("rank")
    out = quota(found, ["query_id"], [F.col("similarity").desc(), F.col("id")], k)
    return out.join(index.payload.withColumnRenamed(index.key, "id"), "id") if payload else out


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of the pairs of `truth` that were found; 1 if there are none."""
    pairs = truth.select("query_id", "id").distinct()
    hit, n = pairs.join(found.select("query_id", "id", F.lit(1).alias("_hit")), ["query_id", "id"], "left").agg(F.count("_hit"), F.count("*")).first()
    return hit / n if n else 1.0


def probes_for(index: Index, queries: DataFrame, k: int, least: float = 0.9, tries: int = 256) -> int:
    """How many lists a search has to read to find `least` of what an exact one finds, doubling from one; all, at the most.

    Measured on at most `tries` of the queries, chosen by hash. What suffices depends on the data: where vectors are spread
    evenly, it is most lists.
    """
    few = cut(queries.where(_directed(index.vector)).select(index.key, index.vector).orderBy(F.xxhash64(index.key), index.key).limit(tries))
    lists = index.centres.count()
    truth = cut(search(index, few, k, exact=True))
    probes = 1
    while probes < lists and recall(search(index, few, k, probes), truth) < least:
        probes *= 2
    return max(1, min(probes, lists))
