"""Periodic runs against a plain search over all periods."""

from __future__ import annotations

import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lathework.llm import runs
from lathework.llm.queries import QUERIES
from tests.llm.brute import sha

SF = "/root/testdata/sf0.01"


def plain_runs(w):
    """All runs of a list of words, period by period."""
    found = {}
    number = {}
    x = np.array([number.setdefault(v, len(number)) for v in w], np.int64)
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate(([0], (x[:-q] == x[q:]).astype(np.int8), [0]))
        edges = np.flatnonzero(np.diff(same))
        for b, e in zip(edges[::2].tolist(), (edges[1::2] + q).tolist(), strict=True):
            if e - b >= max(6, 4 * q):
                found.setdefault((b, e), q)
    return sorted((b, e - b, q) for (b, e), q in found.items())


def plain(doc_id, text, edit=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if edit and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    out = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *told, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for i, x in enumerate(w) if i not in out)))


def test_against_all_periods():
    """Words of few letters, so that periods nest, overlap and touch; many short lists in one group."""
    r = random.Random(5)
    lists = []
    for k in range(1500):
        alphabet = b"ab" if k % 3 else b"abcdefgh"
        w = [bytes([r.choice(alphabet)]) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            unit = [bytes([r.choice(alphabet)]) for _ in range(r.randint(1, 9))]
            times = r.randint(2, 7) * len(unit) + r.randint(0, len(unit))
            at = r.randint(0, len(w))
            w[at:at] = (unit * 9)[:times]
        lists.append(w)
    lists += [[], [b"a"] * 5, [b"a"] * 6, [b"a"] * 1000, [b"a", b"b"] * 3, [b"a", b"b"] * 4, ([b"a"] * 7 + [b"b"]) * 8]
    for w, (s, size, q) in zip(lists, runs.runs_of(lists), strict=True):
        assert list(zip(s.tolist(), size.tolist(), q.tolist(), strict=True)) == sorted(plain_runs(w), key=lambda x: (x[0], x[2])), w


def test_masking():
    """Words outside repeated 5-grams are in no segment, words of runs are all in one; documents are kept apart."""
    w = [*range(100), *([7] * 6), *range(200, 300), *([1, 2] * 4)]
    begin, end = runs.segments(np.array(w * 2), np.array([0, len(w), 2 * len(w)]))
    assert list(zip(begin, end, strict=True)) == [(100, 106), (206, 214), (314, 320), (420, 428)]
    assert runs.K == 5


def texts():
    return [
        None, "", " \n ", "one", "a " * 6, "a " * 5, "x\ty\n" * 4, "the end " * 300 + "of it", "é　ü\x1cz " * 8, "go go go go go go now go go go go go go",
        "a b a b a b a b a c " * 5, "same word " * 7, "one two three four five six seven eight", "q " * 3000 + "r " * 3000,
    ]


def test_query(spark):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_runs"](spark, SF).collect()}
    docs = list(zip(*pq.read_table(f"{SF}/documents.parquet").select(["doc_id", "text"]).to_pydict().values(), strict=True))
    assert got == {d: plain(d, t) for d, t in docs}
    assert sum(r[0] > 0 for r in got.values()) > 80


@pytest.mark.parametrize("group", [runs.GROUP, 10])
def test_odd(spark, monkeypatch, group):
    monkeypatch.setattr(runs, "GROUP", group)
    rows = [(i, t, "own") for i, t in enumerate(texts() * 3)] + [(None, "a " * 9, "own"), (3, "one", "own"), (3, "one", "own")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string")
    got = runs.collapse_runs(docs, edit=True).collect()
    key = lambda r: (r[0] is None, r[0], str(r))
    assert sorted((tuple(r)[:8] for r in got), key=key) == sorted(((d, *plain(d, t)) for d, t, _ in rows), key=key)
    names = runs.collapse_runs(docs.withColumn("doc_id", F.concat(F.lit("k"), "doc_id"))).where("doc_id = 'k4'").collect()
    assert [(r.n_runs, r.collapsed, r.runs[0].period) for r in names] == [(1, "a", 1)]
    assert runs.collapse_runs(docs.limit(0)).collect() == []
