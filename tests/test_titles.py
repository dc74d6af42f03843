"""Titles: keys, likeness, matches and deduplication against a plain loop."""

from __future__ import annotations

import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lathework.functions import titles as functions
from lathework.operators import dedupe, titles


class Keys:
    """The keys of titles, each computed once."""

    def __init__(self, spark):
        self.spark, self.known = spark, {}

    def learn(self, texts):
        new = list({x for x in texts if x not in self.known})
        rows = self.spark.createDataFrame([(i, x) for i, x in enumerate(new)], "i int, t string")
        rows = functions.with_title_parts(rows, "t", "k")
        self.known |= {new[r.i]: r.k for r in rows.collect()}

    def parts(self, title):
        if title not in self.known:
            self.learn([title])
        k = self.known[title]
        return k.canon, k.compact, k.words, k.core, k.sorted, k.bucket, k.years, k.prefix

    def canon(self, title):
        return self.parts(title)[0]


@pytest.fixture(scope="module")
def t(spark):
    keys = Keys(spark)
    keys.learn([r[1] for seed in (7, 8) for n in (60, 120, 150) for r in invented(n, seed)])
    return keys


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("(수정공고) 2031년도 가온 기술 사업 모집 공고", "2031년 가온기술사업"),
        ("[재공고][공모] 가온·나래 과제 안내", "가온ㆍ나래 과제"),
        ("ＡＢ 가온 실증", "ab 가온실증"),
    ],
)
def test_same_keys(t, a, b):
    assert t.canon(a) == t.canon(b) != ""


def test_other_keys(t):
    assert t.canon("가온 2차 모집") != t.canon("가온 3차 모집")
    assert t.canon("가온 추가모집") != t.canon("가온 모집")
    assert t.canon("모집공고") == "모집공고"
    assert t.canon("!!") == "!!"
    assert t.canon("가" + "공고" * 2000) == "가"
    assert t.canon("모집공고 안내") == "모집공고"
    assert t.parts("지원가온지원사업 지원")[3] == "가온"
    assert t.parts("가" + "지원" * 500)[3] == "가"
    assert t.parts("2031년 AI 12개 03호 2032")[5:7] == ("03 12", ["2031", "2032"])
    assert t.canon("") == t.canon(None) == ""


def plain(t, a, b):
    """The likeness of two titles, told in the plainest way; 0 for titles that are not comparable."""
    ka, kb = t.parts(a), t.parts(b)
    la, lb = len(ka[3]), len(kb[3])
    if min(len(ka[0]), len(kb[0])) < 8 or min(la, lb) < 4 or ka[5] != kb[5]:
        return 0.0
    ya, yb = list(ka[6]), list(kb[6])
    for y in list(ya):
        if y in yb:
            ya.remove(y)
            yb.remove(y)
    if len(ya) + len(yb) > 1 or not all(w in kb[1] for w in ka[2]) or not all(w in ka[1] for w in kb[2]):
        return 0.0
    r = max(SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in ((ka[3], kb[3]), (ka[4], kb[4])))
    return r if r >= 0.9 else 0.0


def invented(n, seed=7):
    pick = random.Random(seed)
    words = ["가온", "나래", "다솜라온", "마루실증", "바른데이터", "사랑밸리", "실증지원사업", "플랫폼", "AI", "2차", "3차", "2031년", "2032", "수요기업", "추가"]
    made = []
    for i in range(n):
        w = pick.sample(words, pick.randint(3, 5)) if i % 3 else made[pick.randrange(len(made))][1].split(" ") if made else ["가온", "나래", "마루실증"]
        pick.shuffle(w)
        made.append((i, pick.choice([" ", " ", ""]).join(w) + pick.choice(["", " 모집 공고", " 공고(수정)", " 참여기업 모집"]), pick.choice("xyz"), pick.random() < 0.3))
    return [*made, (n, "", "x", False), (n + 1, None, "y", False), (n + 2, "", "z", False)]


def folded(t, rows, source_blind=False):
    kept, at = [], {}
    for row in rows:
        key = t.canon(row[1])
        if key and key in at:
            if kept[at[key]][3] and not row[3]:
                kept[at[key]] = row
            continue
        if key:
            at[key] = len(kept)
        kept.append(row)
    out = []
    for row in kept:
        near = [(plain(t, k[1], row[1]), -i) for i, k in enumerate(out) if source_blind or k[2] != row[2]]
        best = max(near, default=(0.0, 0))
        if best[0] < 0.9:
            out.append(row)
        elif out[-best[1]][3] and not row[3]:
            out[-best[1]] = row
    return [r[0] for r in out]


@pytest.mark.parametrize("source", ["source", None])
def test_deduplicate(spark, t, source):
    rows = invented(120)
    frame = spark.createDataFrame(rows, "id bigint, title string, source string, dead boolean").repartition(5)
    got = titles.deduplicate(frame, "title", source, "id", F.col("dead"))
    assert [r.id for r in got.orderBy("position").collect()] == folded(t, rows, source is None)
    assert len(folded(t, rows)) < len({t.canon(r[1]) for r in rows})


def test_greedy_alike(spark, t):
    """Of equal titles the first alone is compared; titles without letters stay."""
    rows = invented(120)
    first, kept = set(), []
    for row in rows:
        key = t.canon(row[1])
        if not key:
            kept.append(row)
        elif key not in first:
            first.add(key)
            if not any(k[2] != row[2] and plain(t, k[1], row[1]) for k in kept if t.canon(k[1])):
                kept.append(row)
    frame = spark.createDataFrame(rows, "id bigint, title string, source string, dead boolean").repartition(5)
    assert sorted(r.id for r in dedupe.greedy_alike(frame, "id", "title", "source").collect()) == [k[0] for k in kept]
    assert len(kept) < len(first)


def test_match_titles(spark, t):
    rows, index = invented(60), invented(60, 8)
    schema = "id bigint, title string, source string, dead boolean"
    held = spark.createDataFrame(index, schema).select(F.col("id").alias("key"), F.col("title").alias("held"), F.col("id").alias("order"))
    got = {r.id: (r.key, round(r.ratio, 9)) for r in titles.match_titles(spark.createDataFrame(rows, schema), "id", "title", held, "key", "held", "order").collect()}
    want, by_likeness = {}, 0
    for i, title, *_ in rows:
        if not t.canon(title):
            continue
        same = [k for k, h, *_ in index if t.canon(h) == t.canon(title)]
        near = sorted((-plain(t, h, title), len(t.parts(h)[3]), k) for k, h, *_ in index if plain(t, h, title))
        if same:
            want[i] = (same[0], 1.0)
        elif near:
            want[i] = (near[0][2], round(-near[0][0], 9))
            by_likeness += 1
    assert got == want
    assert by_likeness


def test_signatures_lose_no_pair(t):
    for a, b in itertools.combinations([t.parts(r[1]) for r in invented(150)], 2):
        for k in (3, 4):
            if min(len(a[k]), len(b[k])) > 1 and SequenceMatcher(None, a[k], b[k], autojunk=False).ratio() >= 0.9:
                assert set(a[7]) & set(b[7])


def test_no_rows(spark):
    none = spark.createDataFrame([], "id bigint, title string, source string, dead boolean")
    assert titles.deduplicate(none, "title", "source", "id", F.col("dead")).collect() == []
