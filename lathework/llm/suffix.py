"""Removal of repeated byte strings by suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id. The work is split by
content. Of each LENGTH bytes the least hash of GRAM bytes in a row (the leftmost of equals) is the anchor; neighbouring
strings with one anchor form a stretch, and equal strings have equal anchors at equal places. So everything that can be
equal meets under its anchor, and the steps are (see `blocks` for how blocks and buckets talk):

1. Blocks send their distinct anchors with the number of documents; the answer says which occur in two documents or more.
2. Blocks send the stretches of such anchors, equal ones once with the least id. Under each anchor with several different
   stretches a suffix array brings equal strings together; the answer says which strings of each stretch also start in a
   document with an id less than the least of the block.
3. Blocks apply the answers to their documents.

An anchor in HOT or more documents may have as many different stretches, so its strings go one by one, each as its own
anchor: equal ones are one row per block, and no anchor's stretches are unbounded in number.

Hashes only bring rows together. Rows of one hash count as equal if their bytes are; others stay rows of their own under
the anchor, and the suffix array settles them.

The suffix array is built by grouping: suffixes start in groups by their first bytes, in order. As long as a group has
several, they are told apart by the groups of the suffixes that begin where the bytes they share end, so that each round
doubles the bytes by which groups are told apart; a suffix alone in its group has its place. Rounds are sorts of whole
arrays, of what is left only.

Defined cases: null or empty text has no bytes; a text shorter than LENGTH keeps all; a doc_id names one document, so rows
that repeat it remove nothing from each other; a null doc_id counts as greater than all others; an empty table gives an
empty table; other columns are dropped; a doc_id has to be a number.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathework.llm.blocks import blocks_for, cuts, from_planes, in_blocks, packed, planes, unpacked
from lathework.llm.hashing import U64, _tables, chunks, mixed, sort_order

LENGTH, GRAM = 50, 24
#: Anchors that can lie in one string.
REACH = LENGTH - GRAM + 1
#: Documents from which on an anchor's strings go one by one.
HOT = 2048
#: Bytes whose hashes are computed together.
PIECE = 1 << 17
#: Characters of different stretches that one suffix array takes in, unless one anchor has more.
ARRAY_BYTES = 1 << 15


#: Bytes by which suffixes are grouped at first: nine bits each in a number of 64, as the end comes before all bytes.
_AT_FIRST = 7


def suffix_array(text: bytes) -> list[int]:
    """Starts of the suffixes of `text` in ascending order."""
    return suffix_order(np.frombuffer(text, np.uint8)).tolist()


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of bytes in ascending order: a sort for each doubling of the longest repeat."""
    n = len(text)
    values = np.zeros(n + _AT_FIRST, U64)
    values[:n] = text
    values[:n] += U64(1)
    key = values[:n].copy()
    for j in range(1, _AT_FIRST):
        key <<= U64(9)
        key |= values[j : n + j]
    order, group = np.zeros(n, np.int64), np.zeros(n, np.int64)
    own, left, shared = np.arange(n), np.arange(n), _AT_FIRST
    while len(left):
        # Groups stand in a row in `left`, the places they fill, and by their first places: a sort keeps each in its own.
        by = np.argsort(key)
        own, key = own[by], key[by]
        first = _new(key)
        many = np.diff(np.append(first, len(key)))
        order[left] = own
        group[own] = np.repeat(left[first], many)
        several = np.repeat(many > 1, many)
        own, left = own[several], left[several]
        after = own + shared
        inside = after < n
        key = group[own].astype(U64) << U64(32)
        key[inside] |= group[after[inside]].astype(U64) + U64(1)
        shared *= 2
    return order


_STRETCH, _STRING, _ANCHOR = U64(0xA24BAED4963EE407), U64(0x8CB92BA72F3D8DD7), U64(0x2545F4914F6CDD1D)
_UPPER = np.uint64(0xFFFFFFFF00000000)
_LAST = np.uint64((1 << 64) - 1)


@dataclass(frozen=True)
class _Repeats:
    """What of a block can repeat, and what is sent of it."""

    #: Stretches sorted by anchor and hash, and where in them equal ones begin; the first has the least document.
    own: np.ndarray
    first: np.ndarray
    #: Of these different stretches, those sent whole and those sent string by string, by place, with their numbers of strings.
    whole: np.ndarray
    apart: np.ndarray
    many: np.ndarray
    #: Number of each such string among the different ones.
    string: np.ndarray
    #: Stretches sent whole and then different strings, put in the order of anchors; anchors, places and strings in that order.
    order: np.ndarray
    anchor: np.ndarray
    place: np.ndarray
    strings: np.ndarray


class _Block:
    """The documents of a block by ascending id, their bytes in a row, and their stretches in place order."""

    def __init__(self, t: pa.Table) -> None:
        t = t.sort_by([("doc_id", "ascending")])
        self.ids = t.column("doc_id")
        texts = [x or b"" for x in t.column("text").cast(pa.binary()).to_pylist()]
        sizes = np.array([len(x) for x in texts], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(sizes)))
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        # Ids in unsigned order; null comes last.
        self.order = np.array([(1 << 64) - 1 if d is None else d + (1 << 63) for d in self.ids.to_pylist()], np.uint64)
        found = [self._piece(a, b) for a, b in chunks(texts, PIECE)]
        self.anchor, self.stretch, self.at, self.strings = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(4))
        self.doc = self.docs_at(self.at) if len(self.at) else np.zeros(0, np.uint64)

    def _piece(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        """Stretches of documents a..b: hashes of the anchor and of the bytes, the place, and the number of strings."""
        base = int(self.begin[a])
        data = self.data[base : int(self.begin[b])]
        n = len(data)
        if n < LENGTH:
            return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        powers, inverse = _tables(n + 1)
        sums = np.empty(n + 1, U64)
        sums[0] = 0
        np.cumsum((data.astype(U64) + U64(1)) * powers[:n], out=sums[1:])
        grams = mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
        # The upper half of the hash, then the place: the least is the leftmost of equals.
        least, width = grams & _UPPER, 1
        least |= np.arange(len(grams), dtype=np.uint64)
        while width < REACH:
            step = min(width, REACH - width)
            least = np.minimum(least[step:], least[:-step])
            width += step
        marks = np.zeros(n + 1, np.int32)
        first, last = self.begin[a:b] - base, self.begin[a + 1 : b + 1] - base - LENGTH + 1
        long = last > first
        np.add.at(marks, first[long], 1)
        np.add.at(marks, last[long], -1)
        starts = np.flatnonzero(np.cumsum(marks))
        if not len(starts):
            return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        chosen = (least[starts] & ~_UPPER).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1))))
        at, strings = starts[new], np.diff(np.append(new, len(starts)))
        whole = mixed((sums[at + strings + LENGTH - 1] - sums[at]) * inverse[at] ^ _STRETCH)
        # Anchors are small hashes; mixed anew they spread over all buckets.
        return mixed(grams[chosen[new]] ^ _ANCHOR), whole, at + base, strings

    def repeated(self, codes: np.ndarray) -> _Repeats:
        """What can repeat, of the stretches; `codes` has a number for each distinct anchor: 0 no, 1 yes, 2 string by string.

        Stretches that are equal go together in either case, so that copies within the block aren't taken apart each.
        """
        own = np.argsort(self.anchor, kind="stable")
        first = _new(self.anchor[own])
        code = np.repeat(codes.astype(np.uint8), np.diff(np.append(first, len(own))))
        hot = np.zeros(len(own), bool)
        hot[own[code == 2]] = True
        own = own[code > 0]
        own = own[np.lexsort((self.stretch[own], self.anchor[own]))]  # stable: places, and so documents, stay in ascending order
        first = _kinds(self.data, self.at[own], self.strings[own] + (LENGTH - 1), self.anchor[own], self.stretch[own])
        model = own[first]
        whole, apart = np.flatnonzero(~hot[model]), np.flatnonzero(hot[model])
        apart = apart[np.argsort(model[apart])]
        begin, many = self.at[model[apart]], self.strings[model[apart]]
        at = np.repeat(begin - (np.cumsum(many) - many), many)
        at += np.arange(len(at))
        alone = np.zeros(len(at), U64)
        powers = _tables(LENGTH)[0]
        for a in range(0, len(at), PIECE):
            for j in range(LENGTH):
                alone[a : a + PIECE] += (self.data[at[a : a + PIECE] + j].astype(U64) + U64(1)) * powers[j]
        alone = mixed(alone ^ _STRING)
        by, alone = sort_order(alone)
        different = _kinds(self.data, at[by], np.full(len(by), LENGTH), alone)
        string = np.empty(len(by), np.int64)
        string[by] = np.repeat(np.arange(len(different)), np.diff(np.append(different, len(by))))
        anchor = np.concatenate((self.anchor[model[whole]], alone[different]))
        place = np.concatenate((self.at[model[whole]], at[by[different]]))
        strings = np.concatenate((self.strings[model[whole]], np.ones(len(different), np.int64)))
        order = np.argsort(anchor, kind="stable")
        return _Repeats(own, first, whole, apart, many, string, order, anchor[order], place[order], strings[order])

    def docs_at(self, place: np.ndarray) -> np.ndarray:
        """The documents that hold places, as numbers in the order of ids."""
        return self.order[np.searchsorted(self.begin, place, side="right") - 1]

    def repeats(self, found: _Repeats, bits: np.ndarray) -> np.ndarray:
        """Whether the string that begins at each byte also starts in an earlier document; `bits` answers for what was sent."""
        answer = np.empty(len(bits), np.uint64)
        answer[found.order] = bits
        n = len(found.whole)
        of_kind = np.zeros(len(found.first), np.uint64)
        of_kind[found.whole] = answer[:n]
        if len(found.apart):
            # A string repeats by the answer, or as a stretch of an earlier document of the block has it.
            place = np.empty(len(bits), np.int64)
            place[found.order] = found.place
            begins = np.cumsum(found.many) - found.many
            gone = answer[n:][found.string] > 0
            gone |= np.repeat(self.doc[found.own[found.first[found.apart]]], found.many) > self.docs_at(place[n:])[found.string]
            each = gone.astype(np.uint64) << (np.arange(len(gone)) - np.repeat(begins, found.many)).astype(np.uint64)
            of_kind[found.apart] = np.add.reduceat(each, begins)
        many = np.diff(np.append(found.first, len(found.own)))
        at, strings, doc = self.at[found.own], self.strings[found.own], self.doc[found.own]
        # Where a document of the block itself has the stretch earlier, all of its strings repeat.
        bits = np.where(doc > np.repeat(doc[found.first], many), _LAST, np.repeat(of_kind, many))
        bits &= (np.uint64(1) << strings.astype(np.uint64)) - np.uint64(1)
        some = np.flatnonzero(bits)
        at, bits = at[some], bits[some]
        hit = np.zeros(len(self.data), bool)
        for j in range(REACH):
            hit[at[bits >> np.uint64(j) & np.uint64(1) > 0] + j] = True
        return hit


def _new(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from those before."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(out)


def _kinds(data: np.ndarray, begin: np.ndarray, size: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from those before in a key or in their bytes, which are `size` of `data` from `begin` on."""
    new = np.zeros(len(begin), bool)
    new[_new(size, *keys)] = True
    same = np.flatnonzero(~new)
    if len(same):
        # Eight bytes at a time, from any place; a row has LENGTH at least, and its last eight may overlap those before.
        wide = np.ndarray(len(data) - 7, np.uint64, data, strides=1)
        for a in range(0, len(same), PIECE):
            some = same[a : a + PIECE]
            here, before, last = begin[some], begin[some - 1], size[some] - 8
            other = np.zeros(len(some), bool)
            for j in range(0, int(last.max()) + 8, 8):
                at = np.minimum(j, last)
                other |= wide[here + at] != wide[before + at]
            new[some] = other
    return np.flatnonzero(new)


_FIRST = "bucket int, block int, n int, anchors binary, docs binary"
_ANSWER = "block int, bucket int, n int, answer binary"
_SECOND = "bucket int, block int, n int, anchors binary, strings binary, docs binary, least decimal(20,0), data binary"


def _announce(buckets: int):
    """A block's documents to packets of their distinct anchors."""

    def run(t: pa.Table) -> pa.Table:
        b = _Block(t)
        order = np.argsort(b.anchor, kind="stable")
        anchor, doc = b.anchor[order], b.doc[order]
        each = _new(anchor, doc)
        anchor = anchor[each]
        new = _new(anchor)
        docs = np.diff(np.append(new, len(anchor)))
        anchor = anchor[new]
        full, at = cuts(anchor, buckets)
        parts = [slice(i, j) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.table({
            "bucket": pa.array(full, pa.int32()),
            "block": pa.array([t.column("block")[0].as_py()] * len(full), pa.int32()),
            "n": pa.array([s.stop - s.start for s in parts], pa.int32()),
            "anchors": pa.array([packed(anchor[s]) for s in parts], pa.binary()),
            "docs": pa.array([planes(docs[s]) for s in parts], pa.binary()),
        })

    return run


def _answers(t: pa.Table, values: np.ndarray, n: list[int]) -> pa.Table:
    ends = np.cumsum(n)
    return pa.table({
        "block": t.column("block"),
        "bucket": t.column("bucket"),
        "n": t.column("n"),
        "answer": pa.array([planes(values[e - k : e]) for e, k in zip(ends, n, strict=True)], pa.binary()),
    })


def _joined(t: pa.Table, column: str, read) -> np.ndarray:
    return np.concatenate([read(d, k) for d, k in zip(t.column(column).to_pylist(), t.column("n").to_pylist(), strict=True)])


def _in_two(hot: int):
    """Which anchors of a bucket's packets occur in two documents, and which in `hot`."""

    def run(t: pa.Table) -> pa.Table:
        anchor, docs = _joined(t, "anchors", unpacked), _joined(t, "docs", from_planes)
        order = np.argsort(anchor, kind="stable")
        new = _new(anchor[order])
        total = np.repeat(np.add.reduceat(docs[order], new), np.diff(np.append(new, len(order))))
        code = np.empty(len(order), np.uint64)
        code[order] = (total > 1).astype(np.uint64) + (total >= hot)
        return _answers(t, code, t.column("n").to_pylist())

    return run


def _codes(answers: pa.Table) -> np.ndarray:
    answers = answers.sort_by("bucket")
    return np.concatenate([*[from_planes(d, k) for d, k in zip(answers.column("answer").to_pylist(), answers.column("n").to_pylist(), strict=True)], np.zeros(0, np.uint64)])


def _send(buckets: int):
    """A block's documents and its anchors' codes to packets of stretches, and one with the codes for the block itself."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        b, codes = _Block(docs), _codes(answers)
        found = b.repeated(codes)
        anchor, place, strings, doc = found.anchor, found.place, found.strings, b.docs_at(found.place)
        full, at = cuts(anchor, buckets)
        block = docs.column("block")[0].as_py()
        rows = []
        for k, i, j in zip(full.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            s = slice(i, j)
            size = strings[s] + LENGTH - 1
            index = np.repeat(place[s] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            least = doc[s].min()
            rows.append((k, block, s.stop - s.start, packed(anchor[s]), planes(strings[s]), planes(doc[s] - least), int(least), b.data[index].tobytes()))
        rows.append((-1 - block, block, len(codes), b"", b"", b"", 0, planes(codes)))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.decimal128(20, 0), pa.binary())
        names = ["bucket", "block", "n", "anchors", "strings", "docs", "least", "data"]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _array_runs(text: np.ndarray, starts: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the strings of stretches that stand in a row in `text`, in the order of a suffix array, and where equal ones begin."""
    inside = np.zeros(len(text) + 1, np.int32)
    inside[starts] += 1
    np.add.at(inside, starts + strings, -1)
    inside = np.cumsum(inside)[: len(text)] > 0
    order = suffix_order(text)
    order = order[inside[order]]
    return order, _kinds(text, order, np.full(len(order), LENGTH))


def _earlier(t: pa.Table) -> pa.Table:
    """For each stretch of a bucket's packets a bit per string: whether it also starts in a document before the stretch's."""
    if t.column("bucket")[0].as_py() < 0:
        return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "n": t.column("n"), "answer": t.column("data")})
    n = t.column("n").to_pylist()
    anchor, strings = _joined(t, "anchors", unpacked), _joined(t, "strings", from_planes).astype(np.int64)
    doc = _joined(t, "docs", from_planes) + np.repeat(np.array([int(x) for x in t.column("least").to_pylist()], np.uint64), n)
    data = np.frombuffer(b"".join(t.column("data").to_pylist()), np.uint8)
    size = strings + LENGTH - 1
    begin = np.cumsum(size) - size
    powers = _tables(LENGTH + REACH)[0]
    whole = np.zeros(len(size), U64)
    for j in range(LENGTH + REACH - 1):
        has = size > j
        whole[has] += (data[begin[has] + j].astype(U64) + U64(1)) * powers[j]
    order = np.lexsort((doc, whole, anchor))
    kinds = _kinds(data, begin[order], size[order], anchor[order], whole[order])  # different stretches; the first of each has its least document
    kind = np.empty(len(order), np.int64)
    kind[order] = np.repeat(np.arange(len(kinds)), np.diff(np.append(kinds, len(order))))
    model = order[kinds]
    least = doc[model]
    groups = _new(anchor[model])
    ends = np.append(groups[1:], len(model))
    before = np.full((len(model), REACH), _LAST)
    alone = np.repeat(ends - groups, ends - groups) == 1
    before[alone] = least[alone, None]
    several = np.flatnonzero(ends - groups > 1).tolist()
    while several:
        some, total = [], 0
        while several and (not some or total < ARRAY_BYTES):
            g = several.pop()
            some.append(np.arange(groups[g], ends[g]))
            total += int(size[model[some[-1]]].sum())
        own = np.concatenate(some)
        long = size[model[own]]
        starts = np.cumsum(long) - long
        text = data[np.repeat(begin[model[own]] - starts, long) + np.arange(long.sum())]
        place, runs = _array_runs(text, starts, strings[model[own]])
        which = np.searchsorted(starts, place, side="right") - 1
        first = np.minimum.reduceat(least[own[which]], runs)
        before[own[which], place - starts[which]] = np.repeat(first, np.diff(np.append(runs, len(place))))
    bits = np.zeros(len(doc), np.uint64)
    for j in range(REACH):
        bits |= ((before[kind, j] < doc) & (strings > j)).astype(np.uint64) << np.uint64(j)
    return _answers(t, bits, n)


def _apply(keep: bool):
    """A block's documents, its codes and the answers to its stretches, to a row per document."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        b, answers = _Block(docs), answers.sort_by("bucket")
        found = [from_planes(d, k) for d, k in zip(answers.column("answer").to_pylist(), answers.column("n").to_pylist(), strict=True)]
        bits = np.concatenate([*found[1:], np.zeros(0, np.uint64)])
        gone = b.repeats(b.repeated(found[0]), bits)
        width = 1
        while width < LENGTH:  # a string takes all its bytes, which lie in its document
            step = min(width, LENGTH - width)
            gone[step:] |= gone[:-step]
            width += step
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        inner = b.begin[:-1][np.diff(b.begin) > 0]
        opens[inner] = gone[inner]
        left, digests, cut = [], [], []
        for i, j in zip(b.begin[:-1].tolist(), b.begin[1:].tolist(), strict=True):
            rest = b.data[i:j][~gone[i:j]].tobytes()
            left.append(len(rest))
            digests.append(hashlib.sha256(rest).hexdigest())
            if keep:
                cut.append(rest)
        size = np.diff(b.begin)
        columns = {
            "doc_id": b.ids,
            "n_bytes": pa.array(size, pa.int64()),
            "n_removed": pa.array(size - np.array(left, np.int64), pa.int64()),
            "n_spans": pa.array(np.diff(np.searchsorted(np.flatnonzero(opens), b.begin)), pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()),
        }
        return pa.table(columns | ({"kept": pa.array(cut, pa.binary())} if keep else {}))

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and if `keep` the kept bytes.

    What is kept need not be valid UTF-8, as strings may begin and end within a character.
    """
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    blocks = blocks_for(*docs.agg(F.sum(F.octet_length("text")), F.count("*")).first())
    buckets = 2 * blocks
    dealt = in_blocks(docs, blocks)
    first = dealt.groupBy("block").applyInArrow(_announce(blocks), _FIRST).groupBy("bucket").applyInArrow(_in_two(HOT), _ANSWER)
    second = dealt.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(_send(buckets), _SECOND).groupBy("bucket").applyInArrow(_earlier, _ANSWER)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep
    return dealt.groupBy("block").cogroup(second.groupBy("block")).applyInArrow(_apply(keep), schema)
