"""Searches against a plain loop over calls in order, and odd rows."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from lathework.functions.text import clean_title
from lathework.plans import searching

NOW = dt.datetime(2031, 3, 10, 12)
OUTLETS = [
    ("a.example", "a.example", "A", "kr", 2), ("A.example", "a.example", "A abroad", "us", 3), ("a.example", "a.example", "A again", "kr", 5), ("news.b.example", "b.example", "B", "us", 1),
]
LISTED = {"a.example": {"kr": "A", "us": "A abroad"}, "news.b.example": {"us": "B"}}
FIRST = {"a.example": ("A", "kr"), "news.b.example": ("B", "us")}


def plain(calls, entries):
    """Kept (no, id), their outlets, and statuses, by a loop over the calls of each run in order."""
    kept, states, blocked = {}, {}, set()
    for run, no, kind, region, open_, days, status in sorted(calls, key=lambda c: c[1]):
        status = "skipped" if run in blocked else status or "no answer"
        if status == "throttled":
            blocked.add(run)
        raw = stale = 0
        for no_, id_, title, source, host, at in entries if status == "ok" else []:
            if no_ != no:
                continue
            raw += 1
            stale += at is not None and at < NOW - dt.timedelta(days=days, hours=12)
            host, place = (host or "").lower(), region
            if kind == "competitor" or open_:
                outlet, place = FIRST.get(host, (None, region))
                if outlet is None and host and not any(host == d or host.endswith("." + d) for d in ("a.example", "b.example", "bad.example")):
                    outlet = f"web:{host}"
            else:
                outlet = LISTED.get(host, {}).get(region)
            while source and title and title.endswith(f" - {source}"):
                title = title[: -len(source) - 3]
            fits = kind == "competitor" or any("가" <= c <= "힣" for c in title or "") == (region == "kr")
            if kind != "health" and outlet and at and NOW - dt.timedelta(days=days, hours=2) <= at <= NOW + dt.timedelta(hours=1) and title and len(title) > 3 and fits:
                kept[no, id_] = (title, outlet, place)
        states[no] = (status, raw, stale)
    return kept, states


def test_search(spark):
    r = random.Random(5)
    calls = [(r.choice("pqr"), no, r.choice(["topic", "competitor", "health", None]), r.choice(["kr", "us"]), r.choice([True, False, False, None]), r.choice([1, 3]), r.choice(["ok"] * 18 + ["throttled", "HTTP 500", None])) for no in range(60)]
    hosts = ["a.example", "A.EXAMPLE", "news.b.example", "b.example", "x.a.example", "free.example", "bad.example", "very.bad.example", "xa.example", None, ""]
    titles = ["가온 착공 소식", "a plain title", "가온 - S.(x) - S.(x)", "mixed 가 title - Q\\E+", "abc", "", None]
    entries = [(r.randrange(62), f"i{i}", r.choice(titles), r.choice(["S.(x)", "Q\\E+", None, ""]), r.choice(hosts), r.choice([None, *[NOW - dt.timedelta(hours=r.choice([-2, -1, 0, 5, 26, 27, 36, 37, 74, 75, 85]))] * 6])) for i in range(900)]
    make = lambda rows, schema: spark.createDataFrame(r.sample(rows, len(rows)), schema).repartition(3)
    now = F.lit(NOW.isoformat()).cast("timestamp")
    got = searching.search(make(calls, searching.CALL), make(entries, searching.ENTRY), make(OUTLETS, searching.OUTLET), now, ["kr"], blocked=["bad.example"])
    kept, states = plain(calls, entries)
    assert {(x.no, x.id): (x.title, x.outlet, x.region) for x in got.items.collect()} == kept and len(kept) > 20
    told = got.calls.collect()
    assert {x.no: (x.status, x.raw, x.stale) for x in told} == states and len(told) == 60
    assert {x.no: x.kept for x in told} == {no: sum(k[0] == no for k in kept) for no in states}
    runs = {x.run: x for x in got.runs.collect()}
    found = {(x.run, x.warning): (x.n, x.total) for x in got.warnings.collect()}
    for run in "pqr":
        mine = [states[c[1]][0] for c in calls if c[0] == run]
        bad = sum(s != "ok" for s in mine)
        assert (runs[run].total, runs[run].failed, runs[run].skipped, runs[run].complete) == (len(mine), bad, mine.count("skipped"), bad == 0)
        assert found.get((run, "blocked" if "throttled" in mine else "failed")) == ((bad, len(mine)) if bad else None)


def test_warnings_and_watermarks(spark):
    calls = [("p", 1, "health", "kr", False, 1, "ok", 0, 0), ("p", 2, "topic", "us", True, 1, "ok", 100, 70), ("p", 3, "topic", "kr", False, 1, "ok", 10, 8), ("q", 4, "health", "kr", False, 1, "HTTP 500", 0, 0), ("s", 5, "topic", "kr", None, 1, "ok", 3, 3)]
    rows = spark.createDataFrame(calls, searching.CALL + ", raw bigint, stale bigint")
    got = {(r.run, r.warning): (r.n, r.total, r.names) for r in searching.warnings(rows).collect()}
    assert got == {("p", "health_empty"): (1, 3, ["kr"]), ("p", "full"): (1, 3, ["us/topic"]), ("p", "stale"): (1, 3, ["kr/topic"]), ("q", "failed"): (1, 1, [])}
    runs = spark.createDataFrame([("p", True), ("q", False), ("n", True), ("m", False)], "run string, complete boolean")
    held = spark.createDataFrame([("p", NOW), ("q", NOW), ("old", NOW)], "run string, at timestamp")
    later = NOW + dt.timedelta(days=1)
    assert {r.run: r.at for r in searching.watermarks(runs, held, F.lit(later.isoformat()).cast("timestamp")).collect()} == {"p": later, "q": NOW, "old": NOW, "n": later}


def test_empty(spark):
    got = searching.search(spark.createDataFrame([], searching.CALL), spark.createDataFrame([], searching.ENTRY), spark.createDataFrame([], searching.OUTLET), F.lit("2031-03-10").cast("timestamp"), ["kr"])
    assert got.items.collect() == got.calls.collect() == got.runs.collect() == got.warnings.collect() == []


def test_clean_title(spark):
    rows = spark.createDataFrame([("x  y - O - O", "O"), ("x - ", ""), (None, "O"), ("x - a\\Eb", "a\\Eb"), ("x - $1", "$1"), ("x", None)], "t string, s string")
    assert [r[0] for r in rows.select(clean_title(F.col("t"), F.col("s"))).collect()] == ["x y", "x -", None, "x", "x", "x"]
