"""The suffix array against sorted suffixes, and repeats where hashes say less than bytes, in one process."""

from __future__ import annotations

import random
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lathework.llm import suffix
from tests.llm import brute


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abc", bytes(range(256))])
def test_suffix_array(letters):
    r = random.Random(len(letters))
    for n in [*range(12), 50, 333, 1000]:
        text = bytes(r.choice(letters) for _ in range(n))
        assert suffix.suffix_array(text) == sorted(range(n), key=lambda i: text[i:])
    period = b"abaab" * 60
    assert suffix.suffix_array(period) == sorted(range(len(period)), key=lambda i: period[i:])


@pytest.mark.parametrize("n", [1, 6, 7, 8, 14, 15, 4000])
def test_array_takes_no_line_of_python_for_a_byte(n):
    """Rounds over whole arrays: a line or more for each byte took two thirds of the time of the operator."""
    r = random.Random(n)
    for text in (bytes(n), bytes([255]) * n, bytes(r.randrange(256) for _ in range(n)), bytes(r.choice(b"ab") for _ in range(n // 2 + 1)) * 2):
        lines = [0]

        def count(frame, event, _):
            lines[0] += event == "line"  # noqa: B023
            return count  # noqa: B023

        before = sys.gettrace()
        sys.settrace(count)
        try:
            order = suffix.suffix_array(text)
        finally:
            sys.settrace(before)
        assert order == sorted(range(len(text)), key=lambda i: text[i:])  # noqa: B023
        assert lines[0] < max(1000, len(text) / 4)


def test_runs_are_of_equal_strings():
    r = random.Random(3)
    stretches = [bytes(r.choice(b"ab") for _ in range(3)) + b"x" * 60 + bytes(r.choice(b"cd") for _ in range(3)) for _ in range(40)]
    text, size = np.frombuffer(b"".join(stretches), np.uint8), 66
    starts = np.arange(40) * size
    place, runs = suffix._array_runs(text, starts, np.full(40, size - suffix.LENGTH + 1))
    strings = [text[i : i + suffix.LENGTH].tobytes() for i in place.tolist()]
    assert strings == sorted(strings) and sorted(place.tolist()) == [s + j for s in starts.tolist() for j in range(17)]
    assert runs.tolist() == [i for i, x in enumerate(strings) if i == 0 or x != strings[i - 1]]


def grouped(tables: list[pa.Table], by: str) -> list[pa.Table]:
    """What a shuffle makes of tables: one for each value."""
    t = pa.concat_tables(tables)
    values = np.array(t.column(by).to_pylist())
    return [t.take(np.flatnonzero(values == v)) for v in np.unique(values)]


def removed(blocks: list[list[tuple]], hot: int) -> dict:
    """The operator's steps over some blocks."""
    kinds = pa.schema([("block", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string())])
    docs = [pa.Table.from_pylist([{"block": k, "doc_id": d, "text": t} for d, t in b], kinds) for k, b in enumerate(blocks)]

    def of_blocks(answers: list[pa.Table]) -> list[pa.Table]:
        t = pa.concat_tables(answers)
        return [t.filter(pa.compute.equal(t.column("block"), k)) for k in range(len(docs))]

    first = of_blocks([suffix._in_two(hot)(t) for t in grouped([suffix._announce(3)(d) for d in docs], "bucket")])
    second = of_blocks([suffix._earlier(t) for t in grouped([suffix._send(5)(d, a) for d, a in zip(docs, first, strict=True)], "bucket")])
    found = pa.concat_tables([suffix._apply(False)(d, a) for d, a in zip(docs, second, strict=True)]).to_pylist()
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found}


def anagrams() -> list[tuple]:
    """Copies of some passages, some with two letters exchanged, so that sums of bytes do not tell them apart."""
    r = random.Random(7)
    passages = ["".join(r.choice("abcdefghij") for _ in range(130)) for _ in range(4)]
    docs = []
    for d in range(60):
        p = list(r.choice(passages))
        for _ in range(r.choice([0, 1, 1, 3])):
            i = r.randrange(len(p) - 1)
            p[i], p[i + 1] = p[i + 1], p[i]
        docs.append((d, "".join(r.choice("klm") for _ in range(r.randrange(9))) + "".join(p)))
    return [*docs, (60, None), (None, docs[3][1]), (61, "short")]


@pytest.mark.parametrize("hot", [suffix.HOT, 3])
@pytest.mark.parametrize("weak", [False, True])
def test_bytes_decide(hot, weak, monkeypatch):
    docs = anagrams()
    random.Random(1).shuffle(docs)
    if weak:
        monkeypatch.setattr(suffix, "_tables", lambda n: [np.ones(n + suffix.LENGTH, np.uint64)] * 2)
    assert removed([docs[:20], docs[20:21], docs[21:]], hot) == brute.repeats(docs)


@pytest.mark.parametrize("hot", [suffix.HOT, 64])
def test_copies_take_memory_by_what_differs(hot):
    """Blocks of copies took 43 bytes of working memory for each byte of text (string by string 149); on check_h that ended the run."""
    r = random.Random(2)
    passage = "".join(r.choice("abcdefghijklmnop ") for _ in range(900))
    docs = []
    for d in range(1600):
        p = list(passage)
        if d % 2:
            p[r.randrange(900)] = "z"
        docs.append((d, "".join(p)))
    kinds = pa.schema([("block", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string())])
    t = pa.Table.from_pylist([{"block": 0, "doc_id": d, "text": x} for d, x in docs], kinds)
    first = suffix._in_two(hot)(pa.concat_tables([suffix._announce(1)(t)]))
    peaks = []

    def measured(step, *tables):
        tracemalloc.start()
        try:
            return step(*tables)
        finally:
            peaks.append(tracemalloc.get_traced_memory()[1] / sum(len(x) for _, x in docs))
            tracemalloc.stop()

    sent = measured(suffix._send(1), t, first)
    second = pa.concat_tables([suffix._earlier(x) for x in grouped([sent], "bucket")])
    found = measured(suffix._apply(False), t, second).to_pylist()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found} == brute.repeats(docs)
    assert max(peaks) < 30, peaks
