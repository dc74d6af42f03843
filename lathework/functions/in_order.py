"""The in-order ratio of many pairs of short sequences at once, as numpy arrays of numbers that stand for characters.

The ratio is that of `difflib.SequenceMatcher`: the longest common stretch, of equals the first in `a` and then in `b`,
splits both sequences, and so do the parts on its two sides. What it matches stands in order in both, so the longest common
subsequence bounds it, which costs a hundredth of it by words of bits.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa

#: Longest sequences that are compared by arrays; and pairs compared at once, whose arrays stay in the cache.
WIDE, AT_ONCE = 64, 1 << 12
#: What stands behind the end of `a` and of `b`, equal to nothing.
_END_A, _END_B = np.uint32(0xFFFFFFFE), np.uint32(0xFFFFFFFF)


def flat(items: pa.Array, kind: str = "<u4") -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all binary items in one array, and where each one's begin (one more entry than items)."""
    if not len(items):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    items = items.cast(pa.large_binary())
    at = np.frombuffer(items.buffers()[1], np.int64)[items.offset : items.offset + len(items) + 1]
    data = items.buffers()[2]
    numbers = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind).astype(np.uint32) if at[-1] > at[0] else np.zeros(0, np.uint32)
    return numbers, (at - at[0]) // 4


def matrix(numbers: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int, end: np.uint32) -> np.ndarray:
    """Rows of `size` numbers each, filled up with `end`."""
    at = np.arange(width)
    return np.where(at < size[:, None], numbers.take(begin[:, None] + at, mode="clip"), end)


def shared(both: np.ndarray, least: float) -> np.ndarray:
    """How many characters two sequences of so many together have in common at least."""
    return np.ceil(least / 2 * both - 1e-9).astype(np.int64)


def longest_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of the rows of two matrices, both 32 or both 64 wide."""
    kind = np.uint32 if a.shape[1] == 32 else np.uint64
    left = np.full(len(a), np.iinfo(kind).max, kind)  # a bit goes out where a longer subsequence ends
    for j in range(a.shape[1]):
        here = np.packbits(a == b[:, j : j + 1], axis=1, bitorder="little").view(kind)[:, 0]
        both = left & here
        left = (left + both) | (left & ~here)
    return np.bitwise_count(~left).astype(np.int64)


def _stretches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, begin in a, begin in b) of the longest common stretch of each two rows."""
    n = len(a)
    size, end_a, end_b, rows = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
    run = np.zeros((n, b.shape[1] + 1), np.uint8)
    for i in range(a.shape[1]):
        run[:, 1:] = (run[:, :-1] + np.uint8(1)) * (a[:, i : i + 1] == b)
        j = run.argmax(axis=1)
        length = run[rows, j]
        longer = np.flatnonzero(length > size)
        size[longer], end_a[longer], end_b[longer] = length[longer], i + 1, j[longer]
    return size, end_a - size, end_b - size


def _windows(rows: np.ndarray, pair: np.ndarray, begin: np.ndarray, end: np.ndarray, blank: np.uint32) -> np.ndarray:
    at = begin[:, None] + np.arange((end - begin).max())
    return np.where(at < end[:, None], rows[pair[:, None], np.minimum(at, rows.shape[1] - 1)], blank)


def matched(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """How many characters SequenceMatcher matches in each two rows of two matrices, of fewer than 200 columns."""
    total, pair = np.zeros(len(a), np.int64), np.arange(len(a))
    a0, a1, b0, b1 = np.zeros_like(size_a), size_a, np.zeros_like(size_b), size_b
    while len(pair):
        size, in_a, in_b = _stretches(_windows(a, pair, a0, a1, _END_A), _windows(b, pair, b0, b1, _END_B))
        in_a, in_b = a0 + in_a, b0 + in_b
        total += np.bincount(pair, size, len(total)).astype(np.int64)
        parts = [(pair, a0, in_a, b0, in_b), (pair, in_a + size, a1, in_b + size, b1)]
        pair, a0, a1, b0, b1 = (np.concatenate([p[(size > 0) & (q[1] < q[2]) & (q[3] < q[4])] for p, q in zip(x, parts, strict=True)]) for x in zip(*parts, strict=True))
    return total


def _compared(a: pa.Array, b: pa.Array, short, long) -> np.ndarray:
    """short(rows of a, rows of b, sizes, sizes) of the pairs of at most WIDE characters, long(a, b, size, size) of each other pair."""
    (xs, x_at), (ys, y_at) = flat(a), flat(b)
    x_size, y_size = np.diff(x_at), np.diff(y_at)
    out = np.zeros(len(a))
    most = np.maximum(x_size, y_size)
    for low, width in ((0, 32), (32, WIDE)):
        own = np.flatnonzero((most > low) & (most <= width))
        for k in range(0, len(own), AT_ONCE):
            at = own[k : k + AT_ONCE]
            sizes = x_size[at], y_size[at]
            out[at] = short(matrix(xs, x_at[at], sizes[0], width, _END_A), matrix(ys, y_at[at], sizes[1], width, _END_B), *sizes)
    for k in np.flatnonzero(most > WIDE):
        out[k] = long(xs[x_at[k] : x_at[k + 1]].tolist(), ys[y_at[k] : y_at[k + 1]].tolist())
    return out


def may_reach(a: pa.Array, b: pa.Array, least: float) -> np.ndarray:
    """Whether each two may have the ratio `least`: by common subsequences, longer ones by common characters."""
    return _compared(a, b, lambda *pair: _few(*pair, least), lambda x, y: _many(x, y, least)) > 0


def ratios(a: pa.Array, b: pa.Array, least: float = 0.0) -> np.ndarray:
    """SequenceMatcher's ratio of each two, which of 200 characters or more lets very frequent ones of `b` start no match; 0 for what cannot reach `least`."""

    def short(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        out, may = np.zeros(len(n)), np.flatnonzero(_few(x, y, n, m, least))
        out[may] = 2.0 * matched(x[may], y[may], n[may], m[may]) / (n + m)[may]
        return out

    return _compared(a, b, short, lambda x, y: SequenceMatcher(None, x, y).ratio() if _many(x, y, least) else 0.0)


def _few(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, least: float) -> np.ndarray:
    return longest_common(a, b) >= shared(size_a + size_b, least)


def _many(a: list[int], b: list[int], least: float) -> bool:
    return bool((Counter(a) & Counter(b)).total() >= shared(np.array(len(a) + len(b)), least))
