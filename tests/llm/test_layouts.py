"""Records of many layouts, and conversations of odd rows."""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import functions as F

from lathework.llm import chat
from tests.llm import brute

PAIR = [("user", "q"), ("assistant", "a")]
RECORDS = [
    ("messages", {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, PAIR),
    ("turns", {"turns": [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}]}, PAIR),
    ("conversations", {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, PAIR),
    ("conversations", {"conversations": [{"from": "system", "value": "s"}]}, [("system", "s")]),
    ("prompt_completion", {"prompt": "q", "completion": "a"}, PAIR),
    ("prompt_response", {"prompt": "q", "response": "a"}, PAIR),
    ("instruction", {"instruction": "q", "input": "more", "output": "a"}, [("user", "q\n\nmore"), ("assistant", "a")]),
    ("instruction", {"instruction": "q", "input": "", "output": "a"}, PAIR),
    ("instruction_short", {"instruction": "q", "output": "a"}, PAIR),
    ("question_answer", {"question": "q", "answer": "a"}, PAIR),
    # Further fields, other types, other orders, nothing said.
    ("messages", {"id": 5, "messages": [{"content": "q", "role": "user", "name": "x"}, {"role": "assistant", "content": "a", "meta": {"k": [1]}}]}, PAIR),
    ("messages", {"messages": []}, []),
    ("messages", {"messages": [{"role": "user", "content": 12}, {"role": "assistant", "content": None}]}, [("user", "12"), ("assistant", "")]),
    ("prompt_completion", {"completion": "a", "prompt": "q", "score": 0.5}, PAIR),
    ("question_answer", {"question": 1, "answer": True}, [("user", "1"), ("assistant", "true")]),
    ("unknown", {"messages": [{"role": "user"}]}, None),
    ("unknown", {"messages": "q"}, None),
    ("unknown", {"title": "q", "body": "a"}, None),
    ("unknown", [], None),
]


def test_layouts(spark):
    table = [(i, json.dumps(r), "own") for i, (_, r, _) in enumerate(RECORDS)] + [(100, None, "own"), (101, "{", "own"), (102, "", "own")]
    records = spark.createDataFrame(table, "id int, record string, mark string").withColumns({c: F.lit("own") for c in ("parsed", "known", "pieces")})
    made = chat.canonical_turns(records)
    got = {r.id: r for r in made.collect()}
    for i, (layout, record, turns) in enumerate(RECORDS):
        assert got[i].layout == layout, record
        assert (None if got[i].turns is None else [tuple(t) for t in got[i].turns]) == turns, record
        assert (got[i].mark, got[i].parsed, got[i].known) == ("own", "own", "own")
    assert all((got[i].layout, got[i].turns, got[i].fingerprint) == ("unknown", None, None) for i in (100, 101, 102))
    assert got[0].fingerprint != got[10].fingerprint
    # Through the template and back.
    whole = chat.format_chat(made.where(F.col("turns").isNotNull())).select("id", "turns", chat.read_chat(F.col("formatted")).alias("read"))
    assert whole.where(~F.col("turns").eqNullSafe(F.col("read"))).count() == 0
    counts = {(r.layout, r.fingerprint): r.n for r in chat.layouts(records).collect()}
    assert counts[("unknown", None)] == 3
    assert sum(counts.values()) == len(table)


def test_odd_conversations(spark):
    table = [
        (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (1, 2, "assistant", "x</turn>\n### user\n\\###"),
        (None, 0, "assistant", "lost"), (None, None, "user", "first"), (2, 0, "assistant", ""), (3, 5, "a\nb", "\\"), (4, 0, "assistant", "é😀 " * 3000),
    ]
    frame = spark.createDataFrame(table, "conv_id int, turn int, role string, text string").withColumns({c: F.lit("own") for c in ("pieces", "layout", "turns")})
    chats = defaultdict(list)
    for c, turn, role, text in [*table, (-7, 0, "user", chat.FORGED), (-7, 1, "assistant", chat.FORGED)]:
        chats[c].append(((turn is not None, turn), role or "", text or ""))
    got = {r.conv_id: r for r in chat.chat_digest(frame).collect()}
    assert got.keys() == chats.keys()
    escape = lambda t, marks: "".join("\\" + x if x in marks else x for x in brute.re.split(r"(\\|###|</turn>|\n)", t))
    body, name = {"\\", "###", "</turn>"}, {"\\", "###", "</turn>", "\n"}
    for c, turns in chats.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), brute.sha("".join(f"{role}\n{t}\n" for _, role, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), brute.sha(loss))
        assert r.formatted_chars == sum(len(f"### {escape(role, name)}\n{escape(t, body)}</turn>\n") for _, role, t in turns)


def test_typed_records(spark):
    """Structs find the same mappings as JSON texts of the same fields, by their types."""
    rows = [
        ("named_struct('messages', array(named_struct('role', 'user', 'content', 'q'), named_struct('role', 'assistant', 'content', null)), 'id', 7)", "messages", [("user", "q"), ("assistant", "")]),
        ("named_struct('conversations', array(named_struct('from', 'human', 'value', 'q'), named_struct('from', 'gpt', 'value', 'a')))", "conversations", [("user", "q"), ("assistant", "a")]),
        ("named_struct('instruction', 'do', 'input', 'this', 'output', 5)", "instruction", [("user", "do\n\nthis"), ("assistant", "5")]),
        ("named_struct('instruction', 'do', 'output', 'done', 'turns', 'none')", "instruction_short", [("user", "do"), ("assistant", "done")]),
        ("named_struct('other', 1)", "unknown", None),
    ]
    for sql, layout, turns in rows:
        one = spark.sql(f"select {sql} as record")
        typed = chat.canonical_turns(one).collect()[0]
        assert (typed.layout, typed.turns and [tuple(t) for t in typed.turns]) == (layout, turns)
        text = chat.canonical_turns(one.selectExpr("to_json(record, map('ignoreNullFields', 'false')) as record")).collect()[0]
        assert text.layout == layout


def test_conversations_go_through_the_mappings(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 0, "user", "q")], "conv_id bigint, turn bigint, role string, text string")
    assert [(r.layout, r.turns[0].text) for r in chat.conversation_turns(rows).collect()] == [("turns", "q")]
    monkeypatch.setattr(chat, "MAPPINGS", [m for m in chat.MAPPINGS if m.name != "turns"])
    assert [(r.layout, r.turns) for r in chat.conversation_turns(rows).collect()] == [("unknown", None)]


def test_very_many_turns(spark):
    """Masked texts are cut out without a walk from the beginning for each."""
    import time

    rows = spark.sql("select 1L as conv_id, id as turn, if(id % 2 = 0, 'user', 'assistant') as role, concat('é', id, '###') as text from range(30000)")
    chat.chat_digest(rows.limit(10)).collect()
    began = time.monotonic()
    r = chat.chat_digest(rows).where("conv_id = 1").collect()[0]
    assert time.monotonic() - began < 12
    loss = "".join(f"é{i}###" for i in range(1, 30000, 2))
    assert (r.n_turns, r.loss_chars) == (30000, len(loss))
