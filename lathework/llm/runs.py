"""Periodic runs of words: stretches that repeat a short unit again and again, found and cut down to their first unit.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
max(6, 4q) that no neighbouring word extends keeping period q.

Repeated k-gram masking: a run of period q and length L holds each of its words in a k-gram that occurs again q words
away, if k is at most L - q. The least L - q of all runs, five, is the k here. Words outside all 5-grams that a document
has twice or more therefore cannot belong to a run; they are masked, and Main-Lorentz runs on the surviving segments only:
segments are halved again and again, and at each centre and for each period the longest common extensions of the words
there to both sides tell the run that crosses it. All segments of a group of documents are halved together, level by level,
as arrays. Extensions are exact: windows of 2**j words have names by sorting pairs of names of half the length. The k-gram
masks are by 64-bit hashes; a collision of two can only leave a segment in that has no run.

Rows are taken one by one where they lie, without a shuffle; a document has to fit a task. Null and empty texts have no
words and no runs; a null doc_id is kept; equal rows are rows of their own; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lathework.llm.hashing import U64, chunks, mixed

#: A run has this many words at least, and this many times its period.
LEAST, TIMES = 6, 4
#: The least overlap of a run with itself one period later: min over q of max(LEAST, TIMES * q) - q.
K = min(max(LEAST, TIMES * q) - q for q in range(1, LEAST + 1))
#: Bytes of text whose words are numbered and searched together.
GROUP = 4 << 20


class _Numbers(dict):
    """Word to its number, the next one for a new word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _marked(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, begin, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps[:-1]) > 0


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size, one after another."""
    last = np.cumsum(sizes)
    return np.arange(int(last[-1]) if len(last) else 0) - np.repeat(last - sizes, sizes)


def segments(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of words inside repeated k-grams; `at` is where each document begins, with the end."""
    n = len(words)
    sizes = np.diff(at)
    if n < K:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    gram = doc[: n - K + 1].astype(U64)
    for j in range(K):
        gram = mixed(gram * U64(0x9E3779B97F4A7C15) + words[j : n - K + 1 + j].astype(U64) + U64(1))
    whole = np.flatnonzero(doc[: n - K + 1] == doc[K - 1 :])  # k-grams within one document
    order = whole[np.argsort(gram[whole])]
    same = gram[order[1:]] == gram[order[:-1]]
    twice = np.unique(np.concatenate((order[1:][same], order[:-1][same])))
    covered = _marked(n, twice, twice + K)
    opens = covered & np.concatenate(([True], ~covered[:-1] | (doc[1:] != doc[:-1])))
    closes = covered & np.concatenate((~covered[1:] | (doc[1:] != doc[:-1]), [True]))
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = end - begin >= LEAST
    return begin[long], end[long]


def _names(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each j a number for the window of 2**j words at each place, equal where the windows are; windows that pass the end lack."""
    names, width = [np.unique(words, return_inverse=True)[1].astype(np.int64)], 1
    while 2 * width <= longest:
        low = names[-1]
        pairs = low[: len(low) - width] * (int(low.max()) + 1) + low[width:]
        names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
        width *= 2
    return names


def _forward(names: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words from x and from y on are the same (x < y)."""
    size = np.zeros(len(x), np.int64)
    for j in range(len(names) - 1, -1, -1):
        while True:  # the longest window may match more than once
            inside = y + size < len(names[j])
            hit = np.zeros(len(x), bool)
            hit[inside] = names[j][x[inside] + size[inside]] == names[j][y[inside] + size[inside]]
            size[hit] += 1 << j
            if j < len(names) - 1 or not hit.any():
                break
    return size


def _backward(names: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words before x and before y are the same (x < y)."""
    size = np.zeros(len(x), np.int64)
    for j in range(len(names) - 1, -1, -1):
        while True:
            a, b = x - size - (1 << j), y - size - (1 << j)
            inside = a >= 0
            hit = np.zeros(len(x), bool)
            hit[inside] = names[j][a[inside]] == names[j][b[inside]]
            size[hit] += 1 << j
            if j < len(names) - 1 or not hit.any():
                break
    return size


def main_lorentz(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, smallest period) of all runs within the ranges of `words`, sorted; no match passes a range's edge."""
    sizes = end - begin
    base = np.cumsum(sizes + 1) - sizes  # a word of its own before each range
    joined = -1 - np.arange(int((sizes + 1).sum()) + 1, dtype=np.int64)
    inner = np.repeat(base, sizes) + _counted(sizes)
    joined[inner] = words[np.repeat(begin, sizes) + _counted(sizes)]
    if not len(sizes):
        return (np.zeros(0, np.int64),) * 3
    names = _names(joined, int(sizes.max()))
    low, high, found = base, base + sizes, []
    while len(low):
        centre = (low + high) // 2
        most = (high - low) // TIMES
        q = 1 + _counted(most)
        c, left, right = (np.repeat(v, most) for v in (centre, low, high))
        # A run that holds the words before and behind the centre repeats, one period on, the word before the centre or the one a period earlier.
        x, q = np.concatenate((c - 1, c - 1 - q)), np.concatenate((q, q))
        fits = (x >= np.concatenate((left, left))) & (x + q < np.concatenate((right, right)))
        x, q = x[fits], q[fits]
        same = joined[x] == joined[x + q]
        x, q = x[same], q[same]
        start = x - _backward(names, x, x + q)
        length = x + _forward(names, x, x + q) + q - start
        run = length >= np.maximum(LEAST, TIMES * q)
        found.append(np.stack((start[run], length[run], q[run])))
        low, high = np.concatenate((low, centre)), np.concatenate((centre, high))
        large = high - low >= LEAST
        low, high = low[large], high[large]
    start, length, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    first = np.ones(len(start), bool)  # a multiple of a period tells the same stretch
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, q = start[first], length[first], q[first]
    of = np.searchsorted(base, start, side="right") - 1
    start = start - base[of] + begin[of]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def stretched(doc_id: object, n: int) -> np.ndarray | None:
    """The words' places of an edited document: for one in ten ids the words from a place on repeat; None for all others."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def runs_of(texts: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of each list of words: (start, length, period) arrays, by start and then period."""
    numbers = _Numbers()
    sizes = np.array([len(w) for w in texts], np.int64)
    at = np.concatenate(([0], np.cumsum(sizes)))
    words = np.fromiter((numbers[w] for own in texts for w in own), np.int64, int(at[-1]))
    start, length, q = main_lorentz(words, *segments(words, at))
    cut = np.searchsorted(start, at)
    return [(start[a:b] - at[i], length[a:b], q[a:b]) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False))]


def _digest(words: list[bytes], start: np.ndarray, length: np.ndarray, q: np.ndarray, keep: bool) -> tuple:
    rows = list(zip(start.tolist(), length.tolist(), q.tolist(), strict=True))
    best = max(rows, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    if rows:
        out = _marked(len(words), start + q, start + length)
        words = [words[i] for i in np.flatnonzero(~out)]
    text = b" ".join(words)
    told = (len(rows), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
    told += (hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in rows).encode()).hexdigest(), hashlib.sha256(text).hexdigest())
    return (*told, [{"start": a, "length": b, "period": c} for a, b, c in rows], text.decode()) if keep else told


_COLUMNS = {"n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}
_KEPT = {"runs": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), "collapsed": pa.string()}


def collapse_runs(docs: DataFrame, keep: bool = True, edit: bool = False) -> DataFrame:
    """A row for each document: the number of its runs, the one with most periods, hashes of all runs and of the words that stay.

    Of each run the first unit stays. With `keep` the runs and the collapsed text come along. With `edit` one in ten
    documents is first made to repeat itself (see `stretched`), so that results can be held against known runs.
    """
    columns = _COLUMNS | (_KEPT if keep else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in chunks(texts, GROUP):
                words = [(t or b"").split() for t in texts[a:b]]
                if edit:
                    for i, (d, w) in enumerate(zip(ids.slice(a, b - a).to_pylist(), words, strict=True)):
                        if (places := stretched(d, len(w))) is not None:
                            words[i] = [w[j] for j in places]
                rows = [_digest(w, *r, keep) for w, r in zip(words, runs_of(words), strict=True)]
                made = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), columns.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *made], names=["doc_id", *columns])

    kinds = {"n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs": "array<struct<start:bigint,length:bigint,period:bigint>>"}
    schema = ", ".join([f"doc_id {dict(docs.dtypes)['doc_id']}", *(f"{c} {kinds.get(c, 'string')}" for c in columns)])
    return docs.select("doc_id", "text").mapInArrow(run, schema)
