"""Texts, words and conversations that an earlier form of the operators lost."""

from __future__ import annotations

import public_tokenizers
import pytest

from lathework.llm import chat, pii
from lathework.llm.queries import PACKED, STORED
from lathework.llm.tokens import Encoder
from tests.llm import brute


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r for r in pii.pii_digest(docs).orderBy("doc_id").collect()]


def test_zero_octets(spark):
    texts = ["10.0.0.1 127.0.0.1", "192.168.0.5, 0.0.0.0 and 000.1.1.1", "0256.0.0.1 256.0.0.0 00.00.00.000 10.20.30.40", "0" * 4000 + ".0.0.0", "0" * 4000 + "256.0.0.0"]
    for r, text in zip(found(spark, texts), texts, strict=True):
        want, base = brute.pii(text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want, text
        assert set(base) <= set(r.spans.split(","))
    cleaned = pii.clean(spark.createDataFrame([("host 10.0.0.1 up",)], "text string")).collect()
    assert cleaned[0].text == "host [IP] up"


def test_codes_before_capitals(spark):
    texts = {
        "GB82 WEST 1234 5698 7654 32 Bank": [(0, 27)],
        "GB82WEST12345698765432 Thanks": [(0, 22)],
        "GB82WEST12345698765432 THANKS A LOT": [(0, 22)],
        "DE89 3704 0044 0532 0130 00 A B": [(0, 27)],
        "DE89 3704 0044 0532 0130 00 IBM": [(0, 27)],
        "to NO93 8601 1117 947 BANK 12": [(3, 21)],
        "GB82WEST12345698765432 DE89 3704 0044 0532 0130 00 Now": [(0, 22), (23, 50)],
        "REF: AB12 GB82 WEST 1234 5698 7654 32.": [(10, 37)],
        "iban GB82 WEST 1234 5698 7654 32 bank": [(5, 32)],
        "GB82 WEST 1234 5698 7654 33 Bank": [],
        "GB82WEST12345698765432Thanks": [],
        "\U0001f600 GB82 WEST 1234 5698 7654 32": [(2, 29)],
    }
    got = [[tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("iban:")] for r in found(spark, list(texts))]
    assert got == list(texts.values())
    cleaned = pii.clean(spark.createDataFrame([("pay GB82 WEST 1234 5698 7654 32 Bank",)], "text string")).collect()
    assert cleaned[0].text == "pay [IBAN] Bank"


def same_ids(name, texts):
    """Texts whose ids differ from the library's own."""
    path = public_tokenizers.path(name)
    encoder = Encoder(path)
    whole = encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    return [t for t, ids, e in zip(texts, encoder.encode(texts), whole, strict=True) if ids.tolist() != e.ids]


def test_separators():
    texts = [f"a{c}b {c} {c}c  d{c}\n" for c in "\x1c\x1d\x1e\x1f\x85\xa0 　᠎​﻿"]
    assert same_ids(STORED, [*texts, "\x1c", " \x1f ", "plain text"]) == []


def test_blanks_before_added_tokens():
    blanks = ["", " ", "\n", "\n\n", " \n", "\n ", "  ", "\t\n", "\r\n", "\n\n\n"]
    texts = [f"end.{a}<|endoftext|>{b}Next" for a in blanks for b in blanks]
    assert same_ids(PACKED, [*texts, "\n\n<|endoftext|>", "x\n\n<|endoftext|>\n\n<|endoftext|>"]) == []
    assert same_ids(STORED, texts) == []


def test_long_conversation(spark):
    long = "é<" * 10_000_001
    table = [(1, 0, "user", "q"), (1, 1, "assistant", long), (2, 0, None, None), (2, 1, "assistant", ""), (None, 0, "assistant", r"### \ </turn>")]
    frame = spark.createDataFrame(table[:1] + table[2:], "conv_id bigint, turn bigint, role string, text string")
    frame = frame.union(spark.sql(f"select 1L, 1L, 'assistant', repeat('é<', {len(long) // 2})"))
    got = {r.conv_id: r for r in chat.chat_digest(frame).collect()}
    for c in (1, 2, None):
        turns = [(role or "", text or "") for conv, _, role, text in table if conv == c]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), brute.sha("".join(f"{role}\n{t}\n" for role, t in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), brute.sha(loss))


def test_long_record(spark):
    records = spark.sql("select concat('{\"prompt\":\"', repeat('x', 20000001), '\",\"completion\":\"y\"}') as record")
    with pytest.raises(Exception, match="beyond the parser's limits"):
        chat.canonical_turns(records).collect()
    small = spark.createDataFrame([("{",), (None,), ('{"prompt":"a","completion":"b"}',)], "record string")
    assert sorted(r.layout for r in chat.canonical_turns(small).collect()) == ["prompt_completion", "unknown", "unknown"]


def test_many_matches(spark):
    """Texts of more matches than one fold takes, wide characters between, and redaction of overlapping spans."""
    texts = [f"é {i} " * 30 + "a@b.cd, 10.0.0.1 📞 +1 555 010 9999 4111 1111 1111 1111; " * n for i, n in enumerate((1, 63, 64, 65, 300))]
    for r, text in zip(found(spark, texts), texts, strict=True):
        want, base = brute.pii(text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want
        spans = sorted(tuple(map(int, s.split(":")[1:])) + (s.split(":")[0],) for s in r.spans.split(","))
        merged: list[list] = []
        for a, b, kind in spans:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b, kind])
        out, at = "", 0
        for a, b, kind in merged:
            out, at = f"{out}{text[at:a]}[{kind.upper()}]", b
        cleaned = pii.clean(spark.createDataFrame([(text,)], "text string")).collect()[0].text
        assert cleaned == out + text[at:]


def test_many_turns(spark):
    table = [(1, i, ("user", "assistant")[i % 2], f"é{i}\\###") for i in range(200)]
    r = chat.chat_digest(spark.createDataFrame(table, "conv_id bigint, turn bigint, role string, text string")).where("conv_id = 1").collect()[0]
    loss = "".join(t for _, _, role, t in table if role == "assistant")
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (200, len(loss), brute.sha(loss))


def test_plain_words_together():
    """Words of every Latin letter and mark, with what may stand by them, as the library has them."""
    letters = [chr(c) for c in range(0xAA, 0x260)]
    words = [f"{a}{x}{b}" for x in letters for a in ("", "it") for b in ("", "'", ",", "_", "s")]
    marks = [f"{a}{m}{b}" for m in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for a in ("", "don", "\u0130x") for b in ("", "t", "ll", "re", "s")]
    texts = [" ".join(words), " ".join(marks), *words[::7], "\u0130STANBUL \u0130, e\u0301t\u00e9 \u017f 2nd", " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}." for i in range(600))]
    assert same_ids(STORED, texts) == []
