"""The corpus operators as queries over the shared tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.llm import align, chat, decontam, fingerprints, lm, minhash, oracles, packing, pii, quality, runs, sharding, store, suffix
from lathework.llm.common import new_path, table


SHARD_LIMIT = 1 << 20
#: The vocabularies and end ids of packing and of the store.
PACKED, PACKED_END = "byte_bpe_50k.json", 2
STORED, STORED_END = "word_bpe_49k.json", 1


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm.backoff_scores(table(spark, sf_dir, "documents"))
    return scores.withColumn("log_score", F.round("log_score", 4))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), PACKED, PACKED_END, keep_ids=False)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(table(spark, sf_dir, "conversations"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_digest(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.assign_shards(table(spark, sf_dir, "documents"), limit=SHARD_LIMIT)
    return shards.select("doc_id", "shard", "shard_depth", "shard_bytes", "shard_fits")


def op8_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "store")
    store.write_store(table(spark, sf_dir, "documents"), path, STORED, STORED_END)
    return store.verify_store(spark, path)


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), keep=False)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_digest(table(spark, sf_dir, "documents"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), keep=False)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.collapse_runs(table(spark, sf_dir, "documents"), keep=False, edit=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lm, op2_packing, op3_pii, op4_chat, op5_minhash, op6_quality, op7_sharding, op8_store, op9_suffix, op10_decontamination, op11_fingerprints, op12_align, op13_runs)
}

_WORDS = r"""[w for w in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if w <> '']"""

ORACLE_SQL: dict[str, str] = {
    "op1_lm": f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
e AS MATERIALIZED (SELECT doc_id, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
one AS MATERIALIZED (SELECT c, count(*) AS n FROM e GROUP BY c),
two AS MATERIALIZED (SELECT b, c, count(*) AS n FROM e WHERE b IS NOT NULL GROUP BY b, c),
three AS MATERIALIZED (SELECT a, b, c, count(*) AS n FROM e WHERE a IS NOT NULL GROUP BY a, b, c),
n AS (SELECT greatest(count(*) - 1, 1) AS n FROM e),
s AS (SELECT e.doc_id, coalesce(three.n, 1) - 1 AS c3, coalesce(two.n, 1) - 1 AS c2, one.n - 1 AS c1, coalesce(ab.n, 1) - 1 AS cab, coalesce(ob.n, 1) - 1 AS cb,
        (e.b IS NOT NULL)::INT + (e.a IS NOT NULL)::INT AS steps
      FROM e JOIN one ON one.c = e.c LEFT JOIN two ON two.b = e.b AND two.c = e.c LEFT JOIN three ON three.a = e.a AND three.b = e.b AND three.c = e.c
      LEFT JOIN two ab ON ab.b = e.a AND ab.c = e.b LEFT JOIN one ob ON ob.c = e.b),
t AS (SELECT doc_id, c3 > 0 AS is3, c3 <= 0 AND c2 > 0 AS is2,
        CASE WHEN c3 > 0 THEN ln(c3 / cab) WHEN c2 > 0 THEN ln(c2 / cb) + (steps - 1) * ln(0.4::DOUBLE)
             ELSE ln(CASE WHEN c1 > 0 THEN c1::DOUBLE ELSE 0.5::DOUBLE END) + steps * ln(0.4::DOUBLE) - ln(n) END AS v FROM s, n),
g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (is3) AS n3, count(*) FILTER (is2) AS n2, sum(v) AS v FROM t GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(n3, 0)::BIGINT AS n_trigram, coalesce(n2, 0)::BIGINT AS n_bigram,
       coalesce(n - n3 - n2, 0)::BIGINT AS n_unigram, round(coalesce(v, 0), 4) AS log_score
FROM d LEFT JOIN g ON g.doc_id = d.doc_id""",
    "op4_chat": oracles.CHAT,
    "op5_minhash": oracles.NEAR,
    "op6_quality": oracles.QUALITY,
    "op7_sharding": oracles.SHARDS,
    "op9_suffix": oracles.REPEATS,
    "op10_decontamination": oracles.LEAKS,
}
