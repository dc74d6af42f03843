"""Stupid-backoff scores of documents by the n-gram counts of the corpus itself.

A word after its two predecessors scores c(abc) / c(ab) if the trigram occurs elsewhere, else BACKOFF * c(bc) / c(b) if the
bigram does, else BACKOFF**2 * c(c) / N; words near the beginning have fewer predecessors and so fewer steps. "Elsewhere"
is exact: every count is reduced by the occurrence that is being scored, else no n-gram of the corpus would ever back off.
A word that occurs nowhere else counts UNSEEN times. A document's score is the sum of the logarithms.

The relations are: n-grams exploded by documents; the count table, partitioned by ranges of the n-grams' hash; their join
by hash; and the sum by document. They are kept in blocks (see `blocks`): a block of documents sends its distinct n-grams
with their numbers to the partitions of the count table, which add them up and join the totals to the rows they came from;
the totals meet the block's documents again by a cogroup, and each document is summed there. Documents and counts are
shuffled once each, nothing is broadcast, and a frequent n-gram is one row per block.

Defined cases: words are as elsewhere runs of what is no white space, A-Z in small letters; null text, empty text and
text without words have no words and the score 0; repeated rows are scored each and count as occurrences; a null doc_id
is a document; an empty table gives an empty table; other columns are dropped. N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathework.llm.blocks import blocks_for, cuts, from_planes, in_blocks, packed, planes, unpacked
from lathework.llm.common import word_array
from lathework.llm.hashing import U64, chunks, mixed, sort_order, word_hashes

#: The factor of each step back, and the count of a word that occurs nowhere else.
BACKOFF, UNSEEN = 0.4, 0.5
#: Bytes of text in a block: the larger, the fewer n-grams are sent by several blocks.
BLOCK_BYTES = 16 << 20
_FACTORS = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))


def _grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the one-, two- and three-word n-grams that end at each word, 0 where there is none, and where texts begin."""
    words, starts = [], [np.zeros(1, np.int64)]
    for a, b in chunks(texts):
        h, at = word_hashes(texts[a:b])
        words.append(h)
        starts.append(at[1:] + starts[-1][-1])
    one = np.concatenate([*words, np.zeros(0, U64)])
    at = np.concatenate(starts)
    first = np.zeros(len(one) + 2, bool)  # the first and the second word of a text
    first[at[:-1][np.diff(at) > 0]] = True
    two, three = np.zeros_like(one), np.zeros_like(one)
    two[1:] = mixed(one[:-1] * _FACTORS[0] + one[1:])
    three[2:] = mixed((one[:-2] * _FACTORS[1] + one[1:-1]) * _FACTORS[0] + one[2:] + U64(1))
    head = first[: len(one)]
    two[head] = 0
    head = head.copy()
    head[1:] |= first[: len(one)][:-1]
    three[head] = 0
    return one, two, three, at


def _distinct(one: np.ndarray, two: np.ndarray, three: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate([one, two[two > 0], three[three > 0]])
    every.sort()
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(every)), bool), every[1:] != every[:-1])))
    return every[new], np.diff(np.append(new, len(every)))


def _places(one: np.ndarray, two: np.ndarray, three: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The number of distinct n-grams, and for each n-gram its place among them, as `_distinct` has them; 0 where there is none.

    One sort places all: a search for each would read the memory at random, a step at a time.
    """
    has = [np.ones(len(one), bool), two > 0, three > 0]
    order, every = sort_order(np.concatenate([one, two[has[1]], three[has[2]]]))
    new = np.zeros(len(every), np.int32)
    new[1:] = every[1:] != every[:-1]
    del every
    np.cumsum(new, out=new)
    place = np.empty_like(new)
    place[order] = new
    out, begin = [], 0
    for some in has:
        full = np.zeros(len(one), np.int32)
        full[some] = place[begin : (begin := begin + np.count_nonzero(some))]
        out.append(full)
    return (int(new[-1]) + 1 if len(new) else 0, *out)


def _texts(t: pa.Table) -> list[bytes | None]:
    return t.column("text").cast(pa.binary()).to_pylist()


def _count(buckets: int):
    """A block's documents to a packet (bucket, block, n, hashes, counts) for each part of the count table."""

    def run(t: pa.Table) -> pa.Table:
        grams, counts = _distinct(*_grams(_texts(t))[:3])
        full, at = cuts(grams, buckets)
        cut = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
        return pa.table({
            "bucket": pa.array(full, pa.int32()),
            "block": pa.array(np.full(len(full), t.column("block")[0].as_py()), pa.int32()),
            "n": pa.array([b - a for a, b in cut], pa.int32()),
            "hashes": pa.array([packed(grams[a:b]) for a, b in cut], pa.binary()),
            "counts": pa.array([planes(counts[a:b]) for a, b in cut], pa.binary()),
        })

    return run


def _total(t: pa.Table) -> pa.Table:
    """All packets of a bucket to the totals of their n-grams, in the packets' order."""
    n = t.column("n").to_pylist()
    hashes = np.concatenate([unpacked(d, k) for d, k in zip(t.column("hashes").to_pylist(), n, strict=True)])
    counts = np.concatenate([from_planes(d, k) for d, k in zip(t.column("counts").to_pylist(), n, strict=True)])
    order, hashes = sort_order(hashes)
    new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
    sums = np.add.reduceat(counts[order], np.flatnonzero(new))
    totals = np.empty_like(counts)
    totals[order] = sums[np.cumsum(new) - 1]
    ends = np.cumsum(n)
    return pa.table({
        "block": t.column("block"),
        "bucket": t.column("bucket"),
        "n": t.column("n"),
        "totals": pa.array([planes(totals[e - k : e]) for e, k in zip(ends, n, strict=True)], pa.binary()),
    })


def _score(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """A block's documents and its n-grams' totals to a row per document; the score leaves out the division by N."""
    one, two, three, at = _grams(_texts(docs))
    n, *places = _places(one, two, three)
    answers = answers.sort_by("bucket")
    totals = [from_planes(d, k) for d, k in zip(answers.column("totals").to_pylist(), answers.column("n").to_pylist(), strict=True)]
    totals = np.concatenate([*totals, np.zeros(0, np.uint64)]).astype(np.float64)
    if len(totals) != n:
        raise ValueError(f"{len(totals)} totals for {n} n-grams")
    # Counts without the occurrence at hand; 0 where there is no n-gram.
    c1, c2, c3 = (np.where(h > 0, totals[place] - 1, 0) for h, place in zip((one, two, three), places, strict=True))
    before = lambda c: np.concatenate((np.ones(min(1, len(c))), c[:-1]))
    tri = c3 > 0
    bi = ~tri & (c2 > 0)
    uni = ~tri & ~bi
    steps = (two > 0).astype(np.int64) + (three > 0)
    value = np.where(tri, c3 / np.maximum(before(c2), 1), np.where(bi, c2 / np.maximum(before(c1), 1), np.where(c1 > 0, c1, UNSEEN)))
    backed = np.where(tri, 0, np.where(bi, steps - 1, steps))
    logs = np.log(value) + backed * np.log(BACKOFF)

    def summed(x: np.ndarray) -> np.ndarray:
        """By document, each from zero: a difference of running sums would carry the others' rounding."""
        out = np.zeros(len(at) - 1, x.dtype)
        full = np.flatnonzero(np.diff(at))
        if len(full):
            out[full] = np.add.reduceat(x, at[:-1][full])
        return out

    return pa.table({
        "doc_id": docs.column("doc_id"),
        "n_words": pa.array(np.diff(at), pa.int64()),
        "n_trigram": pa.array(summed(tri.astype(np.int64))),
        "n_bigram": pa.array(summed(bi.astype(np.int64))),
        "n_unigram": pa.array(summed(uni.astype(np.int64))),
        "log_score": pa.array(summed(logs)),
    })


def backoff_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, how many words were scored at each order, and log_score (natural logarithm)."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    words, total, rows = docs.agg(F.sum(F.size(word_array(F.coalesce("text", F.lit(""))))), F.sum(F.octet_length("text")), F.count("*")).first()
    blocks = blocks_for(total, rows, BLOCK_BYTES)
    dealt = in_blocks(docs, blocks)
    packets = dealt.groupBy("block").applyInArrow(_count(blocks), "bucket int, block int, n int, hashes binary, counts binary")
    answers = packets.groupBy("bucket").applyInArrow(_total, "block int, bucket int, n int, totals binary")
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words bigint, n_trigram bigint, n_bigram bigint, n_unigram bigint, log_score double"
    # The exchange of `dealt` is the same in both uses: documents are shuffled once.
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score, schema)
    size = float(np.log(max((words or 0) - 1, 1)))
    return scored.withColumn("log_score", F.col("log_score") - F.col("n_unigram") * F.lit(size))
