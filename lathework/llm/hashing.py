"""Hashes of words and bytes of many texts at once, as numpy arrays."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Odd multipliers of the hashes below.
BYTE_FACTOR, WORD_FACTOR = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
MASK = (1 << 64) - 1
#: Bytes of text hashed together: arrays of eight bytes each stay in the cache.
CHUNK = 1 << 17

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _tables(n: int) -> list[np.ndarray]:
    """Powers of BYTE_FACTOR and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, factor in enumerate((BYTE_FACTOR, pow(BYTE_FACTOR, -1, 1 << 64))):
            steps = np.full(n, factor, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all (in place)."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def sort_order(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts 64-bit hashes, of equal ones the first first, and the hashes in it.

    Their upper bits with the places below are sorted as plain numbers, several times as fast as places by hashes. The few
    runs of hashes that differ in the lower bits alone are then put right.
    """
    bits = U64(len(h).bit_length())
    low = (U64(1) << bits) - U64(1)
    key = h & ~low
    key |= np.arange(len(h), dtype=np.uint32)
    key.sort()
    key &= low
    order = key.view(np.int64)
    h = h[order]
    # All hashes of one run lie between its first and last possible one, and no others do: a search finds it.
    run = np.unique(h[1:][h[1:] < h[:-1]] & ~low)
    for a, b in zip(np.searchsorted(h, run).tolist(), np.searchsorted(h, run | low, side="right").tolist(), strict=True):
        own = np.argsort(h[a:b], kind="stable")
        order[a:b], h[a:b] = order[a:b][own], h[a:b][own]
    return order, h


def chunks(texts: list[bytes | None], most: int = CHUNK):
    """Index ranges of consecutive texts of about `most` bytes together, one text at least."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"") + 1
        if i > begin and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and where each text's words begin (one more entry than texts)."""
    joined = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8).copy()
    ends_of_texts = np.cumsum([len(t or b"") + 1 for t in texts])
    joined[(joined >= 65) & (joined <= 90)] += 32
    space = (joined == 32) | ((joined >= 9) & (joined <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space))))  # a word begins or ends here, by turns
    begin, end = edges[::2], edges[1::2]
    powers, inverse = _tables(len(joined) + 1)
    sums = np.empty(len(joined) + 1, U64)
    sums[0] = 0
    np.cumsum((joined.astype(U64) + U64(1)) * powers[: len(joined)], out=sums[1:])
    h = mixed((sums[end] - sums[begin]) * inverse[begin])
    return h, np.concatenate(([0], np.searchsorted(begin, ends_of_texts)))


def shingle_hashes(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """For each text the hashes of its runs of `n` words, in order; of the whole sequence if it has fewer; none without words."""
    out: list[np.ndarray] = []
    for a, b in chunks(texts):
        h, at = word_hashes(texts[a:b])
        runs = np.zeros(max(0, len(h) - n + 1), U64)
        for j in range(n):
            runs *= U64(WORD_FACTOR)
            runs += h[j : len(h) - n + 1 + j]
        mixed(runs)
        for i in range(b - a):
            first, last = int(at[i]), int(at[i + 1])
            if last - first >= n:
                out.append(runs[first : last - n + 1])
            elif last > first:
                whole = last - first
                for x in h[first:last]:
                    whole = (whole * WORD_FACTOR + int(x) + 1) & MASK
                out.append(mixed(np.array([whole], U64)))
            else:
                out.append(np.zeros(0, U64))
    return out
