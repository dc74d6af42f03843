"""Low ratios by characters: no pair is lost, few are compared, and the order of articles decides."""

from __future__ import annotations

import itertools
import random
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lathework.operators import characters, dedupe


def made(n, letters, seed=1):
    """Titles of words, many of them changed forms of earlier ones; some of one letter, long, empty or equal."""
    r = random.Random(seed)
    out = ["", "가", "가", "가나", "가" * 30, "가" * 17 + "나", "나가" * 120, "가나" * 120, "가다나" * 90]
    while len(out) < n:
        if len(out) % 3 and len(out) > 12:
            t = list(r.choice(out[9:]))
            for _ in range(r.randint(0, max(1, len(t) // 2))):
                k = r.randrange(len(t) + 1)
                t[k : k + r.randint(0, 1)] = r.choice(letters)
            if r.random() < 0.3:
                r.shuffle(t)
            out.append("".join(t))
        else:
            out.append("".join(r.choice(letters) for _ in range(r.randint(4, 40))))
    return list(enumerate(out))


HANGUL = [chr(0xAC00 + 7 * i) for i in range(400)]


@pytest.mark.parametrize("letters", [HANGUL, "abcdefghij 😀"])
@pytest.mark.parametrize("least", [0.6, 0.8])
def test_no_pair_is_lost(spark, letters, least):
    rows = made(150, letters)
    frame = spark.createDataFrame(rows, "id bigint, t string").repartition(3)
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if x and y and SequenceMatcher(None, x, y).ratio() >= least}
    assert {tuple(r) for r in characters.alike(frame, "t", least).collect()} == want
    assert len(want) > 30


def test_few_are_compared(spark):
    """Of 1200 titles in a large alphabet, some 700 thousand pairs, a small part has to be compared."""
    rows = made(1200, HANGUL, 4)
    frame = spark.createDataFrame(rows, "id bigint, t string").repartition(3)
    met = characters.candidates(frame, "t", 0.6).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).collect()
    assert len(met) == len(set(met))
    assert len(met) < 1200 * 1199 / 2 * 0.02


def test_articles_in_order(spark):
    """Rows that have gone remove no others; other groups are only held against equal titles."""
    titles = [("가나다라마바사아자차", "x"), ("가나다라마바사아자차", "y"), ("가나다라마바타파하차", "y"), ("거너다라머버타파하차", "x"), ("가나다라마바타파하거", "z"), (None, "z"), ("", "x"), ("가나다라마바사아자치", "q")]
    rows = [(i, t, s) for i, (t, s) in enumerate(titles + [(t, "xyzq"[i % 4]) for i, (_, t) in enumerate(made(120, HANGUL, 9))])]
    frame = spark.createDataFrame(rows, "id bigint, title string, source string").repartition(4)
    seen, unique = set(), []
    for row in rows:
        if (row[1] or "") not in seen:
            seen.add(row[1] or "")
            unique.append(row)
    gone = set()
    own = [r for r in unique if r[2] in "xyz"]
    for k, a in enumerate(own):
        for b in own[k + 1 :] if a[0] not in gone else []:
            if b[0] not in gone and SequenceMatcher(None, a[1] or "", b[1] or "").ratio() >= 0.6:
                gone.add(b[0])
    got = dedupe.distinct_articles(frame, "id", "title", F.col("source").isin("x", "y", "z"))
    assert sorted(r.id for r in got.collect()) == [r[0] for r in unique if r[0] not in gone]
    assert len(gone) > 10
    assert dedupe.distinct_articles(frame.limit(0), "id", "title", F.lit(True)).collect() == []


def test_few_meet_in_prose(spark):
    """Titles of 30 words, as frequent as in prose and many with one first sentence: few pairs are looked up, and no alike one is lost."""
    r = random.Random(6)
    weights = [1 / (k + 1) for k in range(len(HANGUL))]
    head = r.choices(HANGUL, weights, k=10)
    titles = ["".join((head if k % 5 == 0 else [])[:10] + r.choices(HANGUL, weights, k=20 if k % 5 == 0 else 30)) for k in range(400)]
    titles += [t[:24] + "가나다"[: k % 4] for k, t in enumerate(titles[:60])]
    rows = list(enumerate(dict.fromkeys(titles)))
    frame = spark.createDataFrame(rows, "id bigint, t string").repartition(3)
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if SequenceMatcher(None, x, y).ratio() >= 0.6}
    met = {tuple(p) for p in characters._pairs(characters._ordered(frame, "t"), 0.6).collect()}
    assert want <= met
    assert len(met) < len(rows) * (len(rows) - 1) / 2 * 0.2
    assert {tuple(p) for p in characters.alike(frame, "t", 0.6).collect()} == want


def headed(n, seed=8):
    """Titles with one first sentence, the rest as frequent as in prose, and some shorter ones."""
    r = random.Random(seed)
    weights = [1 / (k + 1) for k in range(len(HANGUL))]
    head = r.sample(HANGUL, 10)
    return list(enumerate(dict.fromkeys("".join(head + r.choices(HANGUL, weights, k=20 if k % 7 else 14)) for k in range(n))))


@pytest.mark.parametrize("block,sent", [(16, characters.SENT), (100, 0)])
def test_common_keys_by_blocks(spark, monkeypatch, block, sent):
    """Keys of more titles than a block give the same pairs, and so do shorter titles' keys that are too many to be sent."""
    monkeypatch.setattr(characters, "BLOCK", block)
    monkeypatch.setattr(characters, "SENT", sent)
    rows = headed(260)
    frame = spark.createDataFrame(rows, "id bigint, t string").repartition(3)
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if SequenceMatcher(None, x, y).ratio() >= 0.6}
    got = [tuple(p) for p in characters.alike(frame, "t", 0.6).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want
    assert len(want) > 30


def test_first_sentence_of_many(spark):
    """8000 titles with one first sentence are 32 million pairs, which the bounds by bits and by subsequences settle in time."""
    rows = headed(8000)
    frame = spark.createDataFrame(rows, "id bigint, t string").repartition(8)
    began = time.monotonic()
    got = {tuple(p) for p in characters.alike(frame, "t", 0.6).collect()}
    assert time.monotonic() - began < 90
    r = random.Random(1)
    for (a, x), (b, y) in (sorted(r.sample(rows, 2)) for _ in range(3000)):
        assert ((a, b) in got) == (SequenceMatcher(None, x, y).ratio() >= 0.6)


def test_near_copies_meet_once(spark):
    """Two near copies share most of their keys, and are given on where these begin and not at each."""
    r = random.Random(3)
    rows = list(enumerate(dict.fromkeys("".join(HANGUL[: k % 20 + 5]) + r.choice(HANGUL) + "".join(HANGUL[k % 20 + 6 : 30]) for k in range(300))))
    frame = spark.createDataFrame(rows, "id bigint, t string").repartition(3)
    ordered = characters.cut(characters._ordered(frame, "t"))
    keyed = characters._keyed(ordered, "same", 0.6)
    shared = keyed.alias("x").join(keyed.alias("y"), "key").where("x.id < y.id")
    assert shared.count() > 20 * len(rows) * (len(rows) - 1) / 2
    assert shared.where("x.before <> y.before OR x.before < 0").count() < shared.count() / 2
    assert {tuple(p) for p in characters.alike(frame, "t", 0.6).collect()} == {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if SequenceMatcher(None, x, y).ratio() >= 0.6}
