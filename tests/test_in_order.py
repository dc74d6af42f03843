"""Ratios of many pairs at once are those of SequenceMatcher, and no bound leaves out a pair that reaches the ratio."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest

from lathework.functions import in_order


def sent(texts):
    return pa.array([t.encode("utf-32-le") for t in texts], pa.binary())


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefgh", [chr(0xAC00 + i) for i in range(60)], "ab😀"])
def test_same_as_sequence_matcher(letters):
    r = random.Random(5)
    a = ["".join(r.choice(letters) for _ in range(r.choice([0, 1, 2, 5, 20, 31, 32, 33, 40, 63, 64, 65, 70, 199, 230]))) for _ in range(1500)]
    b = ["".join(c for c in x if r.random() < 0.8) + "".join(r.choice(letters) for _ in range(r.randint(0, 9))) for x in a]
    want = np.array([SequenceMatcher(None, x, y).ratio() if x or y else 0.0 for x, y in zip(a, b, strict=True)])
    assert (in_order.ratios(sent(a), sent(b)) == want).all()
    for least in (0.6, 0.8, 1.0):
        assert in_order.may_reach(sent(a), sent(b), least)[want >= least].all()
        got = in_order.ratios(sent(a), sent(b), least)
        assert (got[want >= least] == want[want >= least]).all()
        assert (got[want < least] < least).all()


def test_slices_and_no_rows():
    a, b = sent(["", "abc", "abcd", "x"]), sent(["q", "abd", "dcba", "x"])
    assert in_order.ratios(a.slice(1, 2), b.slice(1, 2)).tolist() == [SequenceMatcher(None, x, y).ratio() for x, y in (("abc", "abd"), ("abcd", "dcba"))]
    assert in_order.ratios(a.slice(0, 0), b.slice(0, 0)).tolist() == []


def test_bound_leaves_few():
    """Of titles with one first sentence, few pairs with enough characters in common have them in order."""
    r = random.Random(2)
    letters = [chr(0xAC00 + i) for i in range(300)]
    titles = ["".join(letters[:10] + r.choices(letters, [1 / (k + 1) for k in range(300)], k=20)) for _ in range(4000)]
    may = in_order.may_reach(sent(titles[:2000]), sent(titles[2000:]), 0.6)
    alike = np.array([SequenceMatcher(None, x, y).ratio() >= 0.6 for x, y in zip(titles[:2000], titles[2000:], strict=True)])
    assert alike.any() and may[alike].all()
    assert may.sum() < alike.sum() * 1.5 + 10
