"""Fingerprints against a plain version, and their likeness against that of the whole sets of shingles."""

from __future__ import annotations

import struct

import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from lathework.llm import fingerprints as fp
from lathework.llm.queries import QUERIES
from tests.llm.brute import sha, words

SF = "/root/testdata/sf0.01"


def h64(*values):
    """The hash of a row: each value's with the one before as its seed."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q" if isinstance(v, L) else "<i", v)
        seed = xxhash.xxh64_intdigest(data, seed & (1 << 64) - 1)
    return seed - (1 << 64) if seed >> 63 else seed


class L(int):
    """An integer of 64 bits."""


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def plain(text, bins=256, bits=4, n=5):
    w = words(text)
    if not w:
        return ""
    hashes = [h64(*w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [h64(5, " ".join(w))]
    shift = 64 - bins.bit_length() + 1
    least = {}
    for h in hashes:
        k = (h >> shift) + bins // 2
        least[k] = min(h, least.get(k, h))
    values = []
    for k in range(bins):
        if k in least:
            values.append(least[k])
            continue
        probes = [h64(k, t) % bins for t in range(fp.PROBES)]
        donor = next((p for p in probes if p in least), None)
        if donor is None:
            donor = min(least, key=lambda f: h64(k, f, fp.PROBES))
        values.append(h64(L(least[donor]), k))
    number = 0
    for v in values:
        number = number << bits | (v & (1 << bits) - 1)
    return f"{number:0{bins * bits // 4}x}"


def edited(docs):
    """{row: (text, edited text, the next row's text)}, by descending id and hash."""
    order = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, h64(d[1])), reverse=True)
    out = {}
    for i, (d, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        out[d, t] = (t[: len(t) - half] + following[:half], following)
    return out


def same(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def odd_texts():
    return [
        None, "", " \n", "one", "One", "a b c d", "a b c d e", "a b c d e f", "é ü 😀 x " * 40, "same words " * 300, "line\n" * 9, "😀" * 7, "the quick brown fox jumps over the lazy dog " * 3,
        " ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(2900)),
    ]


@pytest.mark.parametrize(("bins", "bits"), [(256, 4), (64, 1), (16, 8), (128, 2)])
def test_against_plain(spark, bins, bits):
    texts = [t for t in odd_texts() if t is not None]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: r.f for r in docs.select("k", fp.hexadecimal(fp.fingerprint(F.col("text"), bins, bits)).alias("f")).collect()}
    assert got == {k: plain(t, bins, bits) for k, t in enumerate(texts)}


@pytest.mark.parametrize(("bins", "bits"), [(256, 4), (64, 1), (16, 8), (128, 2)])
def test_likeness(spark, bins, bits):
    """Agreeing bins of two packed fingerprints, counted one by one."""
    texts = [" ".join(f"w{i}" for i in range(a, a + 60)) for a in (0, 0, 5, 20, 60, 500)] + [""]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", fp.fingerprint(F.col("text"), bins, bits).alias("f"))
    pairs = docs.alias("a").crossJoin(docs.alias("b")).select("a.k", F.col("b.k").alias("m"), fp.likeness(F.col("a.f"), F.col("b.f"), bins, bits).alias("r"))
    number = [int(plain(t, bins, bits) or "0", 16) for t in texts]
    for r in pairs.collect():
        alike = sum((number[r.k] ^ number[r.m]) >> (bits * k) & (1 << bits) - 1 == 0 for k in range(bins))
        want = max(0.0, (alike / bins - 2**-bits) / (1 - 2**-bits))
        if "" in (texts[r.k], texts[r.m]):
            want = float(texts[r.k] == texts[r.m])
        assert abs(r.r - want) < 1e-9


def test_query(spark):
    docs = [(d, t or "") for d, t in zip(*pq.read_table(f"{SF}/documents.parquet").select(["doc_id", "text"]).to_pydict().values(), strict=True)]
    want = edited(docs)
    errors = []
    rows = QUERIES["op11_fingerprints"](spark, SF).collect()
    assert len(rows) == len(docs)
    texts = dict(docs)
    for r in rows:
        t = texts[r.doc_id]
        changed, following = want[r.doc_id, t]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(changed))
        assert 0 <= r.near_edited <= 1
        assert 0 <= r.near_next <= 1
        errors += [abs(r.near_edited - same(t, changed)), abs(r.near_next - same(t, following))]
        if r.doc_id % 25 == 0:
            assert (r.fingerprint, r.edited_fingerprint) == (plain(t), plain(changed))
    assert sum(errors) / len(errors) < 0.02
    assert max(errors) < 0.16
    assert len({r.fingerprint for r in rows}) >= len(set(texts.values())) - 3


def test_odd(spark):
    rows = [(i * 7 % 31, t, "own") for i, t in enumerate(odd_texts())] + [(None, "a b", "own"), (3, "one", "own"), (3, "one", "own"), (3, "two three four five six seven", "own")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, number string").repartition(3)
    want = edited([(d, t or "") for d, t, _ in rows])
    got = fp.fingerprint_digest(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.fingerprint, r.edited_sha256, r.edited_fingerprint) for r in got) == sorted(
        (str(d), len(t or ""), plain(t), sha(want[d, t or ""][0]), plain(want[d, t or ""][0])) for d, t, _ in rows
    )
    one = fp.fingerprint_digest(docs.where("doc_id is null")).collect()
    assert [(r.near_edited, r.near_next) for r in one] == [(one[0].near_edited, 1.0)]
    assert fp.fingerprint_digest(docs.limit(0)).collect() == []
    names = fp.fingerprint_digest(docs.withColumn("doc_id", F.concat(F.lit("k"), "doc_id")))
    assert names.count() == len(rows)


def test_in_turn(spark):
    numbers = fp.in_turn(spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("v")), [F.col("v").desc()]).collect()
    assert sorted((r.number, r.v, r.among) for r in numbers) == [(i, 999 - i, 1000) for i in range(1000)]
