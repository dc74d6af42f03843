"""Plain versions of the operators, over lists of rows, to hold results against."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import log

import numpy as np

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def words(text, low=True):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(SMALL) if low else text)


def lm(docs):
    """{doc_id: (n_words, at order 3, 2, 1, score)}"""
    counts = [Counter(), Counter(), Counter()]
    split = [(d, words(t)) for d, t in docs]
    for _, w in split:
        for k in range(3):
            counts[k].update(tuple(w[i : i + k + 1]) for i in range(len(w) - k))
    n = max(sum(counts[0].values()) - 1, 1)
    out = {}
    for d, w in split:
        at, score = [0, 0, 0], 0.0
        for i in range(len(w)):
            steps = 0
            for k in range(min(i, 2), -1, -1):
                c = counts[k][tuple(w[i - k : i + 1])] - 1
                if c > 0 or k == 0:
                    below = counts[k - 1][tuple(w[i - k : i])] - 1 if k else n
                    score += log((c or 0.5) / below) + steps * log(0.4)
                    at[k] += 1
                    break
                steps += 1
        out[d] = (len(w), at[2], at[1], at[0], score)
    return out


def ids(path, texts, end):
    from tokenizers import Tokenizer

    encoded = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array([*e.ids, end], "<u4") for e in encoded]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def pii(text):
    text = text or ""
    found = {}
    digits = lambda m: re.sub("[^0-9]", "", m)
    for kind, pattern, holds in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ):
        found[kind] = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if holds(m[0])]
    base = [s for k in ("email", "ip", "card", "phone") for s in found[k]]
    return (*[len(found[k]) for k in ("email", "ip", "card", "phone")], sha(",".join(base))), base


def shingles(text):
    w = words(text)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def near(docs):
    """{doc_id: (n_shingles, component_id)} of documents with distinct ids."""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    full = [d for d in sets if sets[d] and d is not None]
    at = defaultdict(list)
    for d in full:
        for s in sets[d]:
            at[s].append(d)
    for d in full:
        common = Counter(e for s in sets[d] for e in at[s] if e != d)
        for e, n in common.items():
            if 100 * n >= 75 * (len(sets[d]) + len(sets[e]) - n):
                a, b = sorted((top(d), top(e)))
                parent[b] = a
    return {d: (len(sets[d]), None if d is None else top(d)) for d in sets}


def quality(text):
    text = text or ""
    w = words(text, low=False)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = Counter(windows)
    hit = {i + j for i, x in enumerate(windows) if twice[x] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(SMALL))


def leaks(docs, items):
    """{doc_id: (n_words, n_hit, n_items, digest)}"""
    windows = defaultdict(set)
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(item)
    sizes = {len(x) for x in windows}
    out = {}
    for d, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    found |= own
                    hit |= set(range(i, i + n))
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))))
    return out


def repeats(docs):
    """{doc_id: (n_bytes, n_removed, n_spans, digest of the rest)} of documents with distinct ids, null the last."""
    rows = sorted(((1 << 63 if d is None else d), d, (t or "").encode()) for d, t in docs)
    first = {}
    for key, _, b in rows:
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], key)
    out = {}
    for key, d, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < key:
                gone[s : s + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def crc(ids):
    return zlib.crc32(ids.tobytes())
