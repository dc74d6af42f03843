"""Places of n-grams by one sort, and scores without a search for each word, in one process."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from lathework.llm import lm
from lathework.llm.hashing import sort_order


@pytest.mark.parametrize("top", [3, 1000, 1 << 17, 1 << 40, (1 << 64) - 1])
def test_sort_order(top):
    r = np.random.default_rng(top % 97)
    for n in (0, 1, 2, 3, 7, 1000, 5000):
        h = r.integers(0, top, n, dtype=np.uint64, endpoint=True)
        order, ordered = sort_order(h)
        assert order.tolist() == np.argsort(h, kind="stable").tolist() and (ordered == h[order]).all()
    # Some runs of hashes that differ in the bits alone that places take, with equal ones among them.
    h = (r.integers(0, 30, 1000, dtype=np.uint64) << np.uint64(40)) + r.integers(0, 50, 1000, dtype=np.uint64)
    order, ordered = sort_order(h)
    assert order.tolist() == np.argsort(h, kind="stable").tolist() and (ordered == h[order]).all()


def texts() -> list[str | None]:
    r = random.Random(5)
    words = [f"w{int(r.paretovariate(0.5)) % 200}" for _ in range(3000)]
    return [None, "", " \t", "one", "one two", *[" ".join(words[i : i + r.randrange(40)]) for i in range(0, 3000, 30)]]


def test_places_are_those_of_the_sorted_ngrams():
    one, two, three, _ = lm._grams([(t or "").encode() for t in texts()])
    grams, _ = lm._distinct(one, two, three)
    n, *places = lm._places(one, two, three)
    assert n == len(grams)
    for h, place in zip((one, two, three), places, strict=True):
        assert (grams[place[h > 0]] == h[h > 0]).all() and not place[h == 0].any()
    assert lm._places(*[np.zeros(0, np.uint64)] * 3)[0] == 0


def test_scores_search_no_words(monkeypatch):
    """Searches are for places of texts at most: one for each n-gram took four fifths of the time of scoring."""
    some = texts()
    docs = pa.table({"block": pa.array([0] * len(some), pa.int32()), "doc_id": pa.array(range(len(some)), pa.int64()), "text": pa.array(some, pa.string())})
    packets = lm._count(3)(docs)
    answers = pa.concat_tables([lm._total(packets.filter(pa.compute.equal(packets.column("bucket"), b))) for b in range(3)])
    searched, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *more, **named: searched.append(np.size(v)) or search(a, v, *more, **named))
    scored = lm._score(docs, answers)
    assert sum(scored.column("n_words").to_pylist()) > 1500
    assert sum(searched) <= len(some)
    with pytest.raises(ValueError, match="totals"):
        lm._score(docs, answers.slice(1))
