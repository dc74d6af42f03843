"""Mail and tasks."""

from __future__ import annotations

import base64
import json

from pyspark.sql import functions as F

from lathework.operators import mail, tasks


def b64(text):
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def part(kind, text=None, name=None, parts=None):
    return {"mimeType": kind, "filename": name, "body": {"data": text and b64(text)}, "parts": parts}


def raw(i, thread, sender, at, payload, labels=(), subject="Hello", to="me@own.example"):
    payload["headers"] = [{"name": "From", "value": sender}, {"name": "SUBJECT", "value": subject}, {"name": "To", "value": to}]
    return {"id": i, "threadId": thread, "labelIds": list(labels), "internalDate": str(at), "snippet": f"snip  {i}", "payload": payload}


REPLY = "This is a new answer, long enough.\n\nOn Monday Ann wrote:\n> old words"


def box(spark):
    rows = [
        raw("a", "t1", "'Ann B' via Group <ann@x.example>", 100, part("multipart/mixed", parts=[part("multipart/alternative", parts=[part("text/plain", REPLY + " äß?>"), part("text/html", "<p>no</p>")]), part("application/pdf", "x", "f.pdf"), part("image/png", "x", "i.png")])),
        raw("b", "t1", "bob@gmail.com", 200, part("text/html", "<p>one</p><p>two</p>"), ["IMPORTANT"], subject=""),
        raw("c", "t2", "notifications@github.com", 300, part("text/plain", "> short\nhi")),
        raw("d", "t1", "me@own.example", 400, part("text/plain", ""), ["SENT"], subject="(광고) x"),
        raw("e", "t3", "ad@x.example", 500, part("text/plain", "buy"), subject=" (광고) buy", to="all@own.example"),
    ]
    return spark.read.schema(mail.raw_schema()).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


def test_messages(spark):
    got = {r.id: r for r in mail.messages(box(spark)).collect()}
    assert got["a"].body == "This is a new answer, long enough."
    assert got["a"].quoted == "On Monday Ann wrote:\n> old words äß?>"
    assert got["a"].attachments == ["f.pdf"]
    assert (got["b"].body, got["b"].subject, got["b"].from_addr) == ("one\ntwo", "(no subject)", "bob@gmail.com")
    assert (got["c"].body, got["c"].quoted) == ("> short\nhi", "")
    assert (got["d"].body, got["d"].snippet) == ("", "snip d")
    shown = mail.messages(box(spark)).select("id", mail.sender(F.col("from_name"), F.col("from_addr"), "own.example").alias("s"))
    assert {r.id: r.s for r in shown.collect()} == {"a": "Ann B (x.example)", "b": "bob@gmail.com", "c": "notifications@github.com", "d": "me@own.example", "e": "ad@x.example"}


def test_cleanup(spark):
    got = mail.messages(box(spark)).select("id", mail.cleanup_category(F.lit(200)).alias("c")).collect()
    assert {r.id: r.c for r in got} == {"a": None, "b": None, "c": "repository", "d": None, "e": "advert"}


def test_threads(spark):
    rows = mail.threads(mail.messages(box(spark)), 100, "me@own.example", ["notifications@github.com"])
    got = {r.thread_id: (r.n, r.important, r.recipient, r.latest.id, r.replied) for r in rows.collect()}
    assert got == {"t1": (2, True, "to", "b", True), "t3": (1, False, "group", "e", False)}
    whole = sum(len(r.text) for r in mail.thread_texts(mail.messages(box(spark))).collect())
    texts = {r.thread_id: r.text for r in mail.thread_texts(mail.messages(box(spark)), whole - 1).collect()}
    assert sum(map(len, texts.values())) < whole
    assert "one\ntwo" in texts["t1"]
    assert "snip c" in texts["t2"]
    assert [r.n for r in mail.frequent(mail.messages(box(spark)), "thread_id", 2).collect()] == [3, 1]
    assert mail.messages(box(spark)).where("id = 'b'").select(mail.relabelled(F.col("labels"), ["X"], ["IMPORTANT"])).first()[0] == ["X"]


def test_tasks(spark):
    page = lambda title, who, status, due, part="core": json.dumps({"Name": {"type": "title", "title": [{"plain_text": title}]}, "Assign": {"people": [{"id": who}]}, "Reviewer": {"people": [{"id": "u1"}]} if title == "both" else {"people": []}, "Status": {"status": {"name": status}}, "Part": {"select": part and {"name": part}}, "Due": {"date": due}})
    rows = [("b1", page("late", "u1", "Doing", {"start": "2031-01-01", "end": None})), ("b1", page("both", "u1", "Doing", {"start": "2031-01-01", "end": "2031-01-05T10:00"})), ("b1", page("done", "u1", "Done", None)), ("b2", page("other", "u2", "Doing", None)), ("b2", page("none", "u1", "Doing", None, None))]
    pages = spark.createDataFrame(rows, "board string, p string").select("board", F.parse_json("p").alias("properties"))
    got = tasks.tasks(pages, "u1", {"Assign": "owner", "Reviewer": "review"}, ["Doing"], "Part", ["Due"])
    assert [(r.title, r.roles, str(r.due), r.part) for r in got.orderBy(*tasks.report_order()).collect()] == [("late", ["owner"], "2031-01-01", "core"), ("both", ["owner", "review"], "2031-01-05", "core"), ("none", ["owner"], "None", "none")]
    day = F.lit("2031-01-05").cast("date")
    r = tasks.report(got, day).first()
    assert (r.status, r.n) == ("Doing", 3)
    assert r.text.split("\n") == ["• `core` *late* - b1 · owner · 2031-01-01 over by 4", "• `core` *both* - b1 · owner·review · today", "• `none` *none* - b2 · owner · none"]
    assert [(r.board, r.n) for r in tasks.board_counts(got, ["b3", "b1", "b2"]).orderBy("position").collect()] == [("b3", 0), ("b1", 2), ("b2", 1)]
    assert [(r.title, r.days) for r in tasks.urgent(got, day).collect()] == [("both", 0), ("late", 4)]
