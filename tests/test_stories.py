"""Copies, stories, repeats, query packing and choices, against plain loops."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lathework.operators import stories


def test_merge_copies(spark):
    pick = random.Random(3)
    rows = [(i, f"g{pick.randrange(40)}", pick.choice([None, f"t{pick.randrange(40)}"]), [f"x{pick.randrange(4)}"], pick.choice(["", None, f"s{i}"])) for i in range(80)]
    rows.append((80, None, None, None, None))
    out, by = [], {}
    for i, gid, title, themes, snippet in rows:
        keys = [k for k in (gid and f"g{gid}", title and f"t{title}") if k]
        mine = next((by[k] for k in keys if k in by), None)
        if mine is None:
            mine = [i, gid, title, [], None]
            out.append(mine)
        for k in keys:
            by.setdefault(k, mine)
        mine[3] += [x for x in themes or [] if x not in mine[3]]
        mine[4] = mine[4] or snippet or mine[4]
    frame = spark.createDataFrame(rows, "at bigint, gid string, title string, themes array<string>, snippet string").repartition(4)
    got = [[r.at, r.gid, r.title, r.themes, r.snippet or None] for r in stories.merge_copies(frame, "at", ["gid", "title"], ["themes"], ["snippet"]).orderBy("at").collect()]
    assert got == [[*r[:4], r[4] or None] for r in out]


def test_merge_copies_of_one_group(spark, monkeypatch):
    """A group of copies is no single task's, long chains of keys end, and null values of lists stay."""
    from pyspark.sql import GroupedData

    monkeypatch.setattr(GroupedData, "applyInPandas", lambda *a, **b: (_ for _ in ()).throw(AssertionError("a whole group in one task")))
    rows = [(i, "same", f"t{i}", ["a", None] if i == 7 else [f"x{i % 3}"]) for i in range(300)]
    rows += [(300 + i, f"c{i}", f"c{i + 1}", None) for i in range(50)] + [(350 + i, None, None, ["n"]) for i in range(3)]
    rows += [(400 + i, f"d{i // 2}", f"e{(i + 1) // 2}", []) for i in range(40)]
    frame = spark.createDataFrame(rows, "at bigint, gid string, title string, themes array<string>").repartition(3)
    got = {r.at: r.themes for r in stories.merge_copies(frame, "at", ["gid", "title"], ["themes"], []).collect()}
    want, by = {}, {}
    for at, gid, title, themes in rows:
        keys = [(i, k) for i, k in enumerate((gid, title)) if k]
        mine = next((by[k] for k in keys if k in by), at)
        for k in keys:
            by.setdefault(k, mine)
        held = want.setdefault(mine, [])
        held += [x for x in themes or [] if x not in held]
    assert len([at for at in want if at >= 400]) == 1
    assert got == want


def test_story_numbers(spark):
    rows = [(1, None, "a"), (2, 1, "a"), (3, 2, "a"), (4, 7, "a"), (5, 3, "b"), (6, 3, "a"), (7, 7, "a"), (8, 99, "a"), (9, 6, "a")]
    got = stories.story_numbers(spark.createDataFrame(rows, "no int, said int, region string"), "no", "said", "region")
    assert [(r.no, r.story) for r in got.orderBy("no").collect()] == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 1), (7, 7), (8, 8), (9, 1)]


def test_tiers_and_top(spark):
    make = lambda *s: spark.createDataFrame([(i, x) for i, x in enumerate(s)], "id int, story string")
    tiers = stories.drop_told([make("a", "b"), make("b", "c"), make("c", "d", "e")], "story", make("a", "e"))
    assert [[r.story for r in t.collect()] for t in tiers] == [["b"], ["c"], ["d"]]
    assert sorted(r.id for r in stories.top_stories(make("a", "b", "a", "c"), "story", [F.col("id")], 2).collect()) == [0, 1, 2]


def test_packing(spark):
    sites = [f"site{i:02d}.example" for i in range(20)]
    rows = spark.createDataFrame([("kr", i, s, "(가온 OR 나래)", 2) for i, s in enumerate(sites)] + [("xx", 0, "y" * 200, "z", 1)], "g string, o int, s string, t string, d int")
    got = stories.packed_terms(rows, ["g"], "o", "s", "t", "d").orderBy("g", "pack").collect()
    compose = lambda x: "(가온 OR 나래) " + ("(" if len(x) > 1 else "") + " OR ".join(f"site:{s}" for s in x) + (")" if len(x) > 1 else "") + " when:2d"
    want, now = [], []
    for s in sites:
        if len(compose([*now, s])) > 190:
            want.append(compose(now))
            now = []
        now.append(s)
    want.append(compose(now))
    assert [r.query for r in got] == [*want, None]
    assert len(want) > 2


def test_mentions(spark):
    rows = [(1, "Gaon builds", None, ["g"], True, 5), (2, "Other", "today Narae said", ["n"], True, 4), (3, "Other", "nothing", ["n"], True, 3), (4, "Other", None, ["g"], False, 9), (5, "Other", "Gaon", ["g"], False, 8), (6, None, "Gaon", ["g"], False, 1)]
    frame = spark.createDataFrame(rows, "at int, title string, body string, hits array<string>, home boolean, published int")
    got = stories.split_by_mention(frame, F.col("title"), "body", [("g", "Gaon"), ("n", "Narae")], F.col("home"), "published", "at", 4)
    assert [r.mention for r in got.orderBy("at").collect()] == ["title", "body", "none", "pending", "body", "pending"]
    assert [r.named for r in stories.mentions(frame, F.col("body"), [("g", "Gaon"), ("n", "Narae")]).orderBy("at").collect()] == [[], ["n"], [], [], ["g"], ["g"]]


def test_soonest_first(spark):
    rows = [(0, i, d) for i, d in enumerate([30, -1, None, 40, 5, 2, None, 7], 1)]
    got = stories.soonest_first(spark.createDataFrame(rows, "q int, r int, d int"), "q", "r", F.col("d"))
    assert [(r.r, r.place) for r in got.orderBy("place").collect()] == [(1, 1), (3, 2), (6, 3), (5, 4), (8, 5)]


def test_attachments(spark):
    files = [("신청서.hwp", "u1"), ("사진.png", "u2"), ("가온 공고문.hwpx [178 KB]", "u3"), ("공고.pdf", " "), ("붙임.DOCX", "u5")]
    frame = spark.createDataFrame([(files,), (None,)], "f array<struct<name: string, url: string>>")
    got = [r[0] and [x.url for x in r[0]] for r in frame.select(stories.chosen_attachments(F.col("f"))).collect()]
    assert got == [["u3", "u1"], None]


def test_addresses(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "")], "at int, u string")
    assert sorted(r.at for r in stories.by_canonical_url(frame, F.col("u"), "at").collect()) == [1, 3, 4, 5]
