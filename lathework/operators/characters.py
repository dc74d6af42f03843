"""Pairs of short texts of a low in-order ratio, none of them lost.

The ratio of two strings is twice their common characters, in order, over both lengths. Strings of a ratio of 0.6 need not
share a pair of neighbours, but they share characters in one order: 0.3 times both lengths at least. A text's characters
are ranked by how rare they are in the corpus, equal ones by their places. What two texts leave out is bounded, so the two
rarest characters that they have in common in order stand among the first of each ranking (a prefix filter), and texts
meet by pairs of ranked characters, each pair as it stands in the text. Texts of one length have the shortest prefixes, so
they meet apart from texts of different lengths. Very short and long texts meet by single characters.

Texts of one key lie together in a sorted task, and those of a very common key are compared by pairs of blocks, a pair of
blocks being a group. Before a pair is looked up it has to pass a bound of its common characters by bits, and before the
ratio is computed its longest common subsequence, which the ratio needs as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from lathework.functions import in_order
from lathework.operators.lineage import cut

#: Texts of more characters meet by single ones, since pairs would be too many.
PAIRED = 64
#: Words of 64 bits that tell which characters a text has.
WORDS = 4
#: Texts of a key that are compared within one sorted task; those of more common keys are compared by blocks of so many.
BLOCK = 1 << 11
#: Pairs or keys made at once.
AT_ONCE = 1 << 16
#: Keys of shorter texts that are sent to all executors, at most; more of them meet the longer texts' by a shuffle.
SENT = 1 << 20
#: Bits of a character's rank in a key, and what stands for none. There are no more code points than that.
RANK, NONE = 21, (1 << 21) - 1

_BITS = [f"w{w}" for w in range(WORDS)]


def _ranks(rows: DataFrame, text: str) -> np.ndarray:
    """A number for each code point, the rarest first. There is one for each character, however many texts there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, n = np.unique(in_order.flat(batch.column(0), ">u4")[0], return_counts=True)
            yield pa.record_batch({"char": pa.array(chars, pa.int64()), "n": pa.array(n, pa.int64())})

    counts = rows.select(F.encode(text, "UTF-32")).mapInArrow(count, "char bigint, n bigint").groupBy("char").agg(F.sum("n").alias("n"))
    known = sorted((r.n, r.char) for r in counts.collect())
    ranks = np.zeros(max((c for _, c in known), default=0) + 1, np.uint32)
    ranks[[c for _, c in known]] = np.arange(len(known))
    return ranks


def _bits(ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bits of the texts' characters, each with the number of its occurrence."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((ranks, row))
    row, char = row[order], ranks[order].astype(np.int64)
    place = np.arange(len(row))
    first = np.concatenate(([True], (row[1:] != row[:-1]) | (char[1:] != char[:-1])))[: len(row)]
    token = (char << 21) + place - np.maximum.accumulate(np.where(first, place, 0))
    there = np.zeros((len(at) - 1, 64 * WORDS), bool)
    there[row, ((token * 0x61C8864680B583EB) >> 40) % (64 * WORDS)] = True
    return np.packbits(there, axis=1).view(np.int64)


def _ordered(rows: DataFrame, text: str) -> DataFrame:
    """(id, size, codes, bits): a text's length, its characters as their ranks, of which the rarest is 0, and bits of them."""
    ranks = _ranks(rows, text)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, at = in_order.flat(batch.column(1), ">u4")
            codes = ranks[chars]
            bits = _bits(codes, at)
            data = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer((at * 4).astype(np.int64)), pa.py_buffer(codes.astype("<u4"))])
            yield pa.record_batch([batch.column(0), pa.array(np.diff(at)), data.cast(pa.binary()), *[pa.array(bits[:, w]) for w in range(WORDS)]], names=["id", "size", "codes", *_BITS])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, size bigint, codes binary, {', '.join(f'{w} bigint' for w in _BITS)}"
    return rows.select("id", F.encode(text, "UTF-32")).mapInArrow(told, schema)


def _by_pairs(n: int, least: float) -> bool:
    """Whether a text of so many characters meets by pairs: if two have to be in common with any longer text."""
    return n <= PAIRED and in_order.shared(np.array(2 * n), least) >= 2


def _prefix(n: int, both: int, paired: bool, least: float) -> int:
    """How many characters, of the rarest of `n`, hold one that is in common, or two."""
    return min(max(n - int(in_order.shared(np.array(both), least)) + (2 if paired else 1), 0), n)


def _shortest(n: int, least: float) -> int:
    return int(np.ceil(n * (least / (2 - least)) - 1e-9))


def _asked(n: int, side: str, least: float) -> list[tuple[bool, int]]:
    """(by pairs, length of the prefix) for a text of `n` characters that meets others of its length, longer or shorter ones."""
    if side == "same":
        return [(p := _by_pairs(n, least), _prefix(n, 2 * n, p, least))]
    if side == "lower":
        return [(p := _by_pairs(n, least), _prefix(n, 2 * n + 1, p, least))]
    # A longer text meets those whose length, of the ones that it may be alike to, is of this kind.
    kinds = {_by_pairs(m, least) for m in range(_shortest(n, least), min(n, PAIRED + 2))} | ({False} if n > PAIRED + 1 else set())
    return [(p, _prefix(n, n + _shortest(n, least), p, least)) for p in sorted(kinds)] if _shortest(n, least) < n else []


def _keys(codes: np.ndarray, prefix: int, paired: bool, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each row of a matrix: its rarest characters or pairs of them as they stand in the text; -1 for a repeated one.

    With each key the one before it, or -1. Two texts with equal ones before a key have met there already.
    """
    order = np.argsort(codes, axis=1, kind="stable")[:, :prefix]
    char = np.take_along_axis(codes, order, axis=1).astype(np.int64)
    if paired:
        i, j = np.triu_indices(order.shape[1], 1)
        ahead = order[:, i] < order[:, j]
        first, second = np.where(ahead, char[:, i], char[:, j]), np.where(ahead, char[:, j], char[:, i])
    else:
        first, second = char, np.int64(NONE)
    keys = np.sort((np.int64(tag) << 2 * RANK) | (first << RANK) | second, axis=1)
    before = np.concatenate([np.full((len(keys), min(1, keys.shape[1])), -1), keys[:, :-1]], axis=1)
    return np.where(keys == before, -1, keys), before


def _keyed(ordered: DataFrame, side: str, least: float) -> DataFrame:
    """(key, before, id, size, bits): a row for each key by which a text meets those of its length, longer or shorter ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, at = in_order.flat(batch.column("codes"))
            size = np.diff(at)
            told = batch.select(["id", "size", *_BITS])
            for n in np.unique(size).tolist():
                own = np.flatnonzero(size == n)
                for paired, prefix in _asked(n, side, least):
                    per = max(1, AT_ONCE // max(1, n, prefix * (prefix - 1) // 2 if paired else prefix))
                    for k in range(0, len(own), per):
                        at_once = own[k : k + per]
                        keys, before = _keys(codes.take(at[at_once][:, None] + np.arange(n)), prefix, paired, n % (1 << 20) if side == "same" else 0)
                        row, place = np.nonzero(keys >= 0)
                        yield pa.record_batch([pa.array(keys[row, place]), pa.array(before[row, place]), *told.take(pa.array(at_once[row])).columns], names=["key", "before", *told.schema.names])

    return ordered.mapInArrow(run, StructType([StructField("key", LongType()), StructField("before", LongType()), *[ordered.schema[c] for c in ("id", "size", *_BITS)]]))


def _told(rows: pa.Table, least: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """What each of some texts of one length has to have in common with another by its bits, and these.

    A bit that another text lacks is a character of this one's at least that is not in common.
    """
    size, bits = rows.column("size").to_numpy(), [rows.column(w).to_numpy().view(np.uint64) for w in _BITS]
    return in_order.shared(2 * size, least) - size + sum(np.bitwise_count(w).astype(np.int64) for w in bits), bits


def _common(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """How many bits are common, by words."""
    common = np.uint8(0)
    for x, y in pairs:
        common = common + np.bitwise_count(x & y)
    return common


def _near(need: np.ndarray, bits: list[np.ndarray], before: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows that each row may be alike to, of those behind it and before its `end`; about AT_ONCE pairs are looked at together."""
    partners = end - np.arange(len(end)) - 1
    until = np.cumsum(partners)
    begin = 0
    while begin < len(end):
        stop = max(begin + 1, int(np.searchsorted(until, (until[begin - 1] if begin else 0) + AT_ONCE, side="right")))
        n = partners[begin:stop]
        i = np.repeat(np.arange(begin, stop), n)
        j = np.arange(1, len(i) + 1) + np.repeat(np.arange(begin, stop) - np.cumsum(n) + n, n)
        may = np.flatnonzero((_common((w[i], w[j]) for w in bits) >= np.maximum(need[i], need[j])) & ((before[i] != before[j]) | (before[i] < 0)))
        yield i[may], j[may]
        begin = stop


def _met_by_key(ordered: DataFrame, least: float) -> DataFrame:
    """(a, b): texts of one length that share a key and may have enough in common by their bits; some come several times."""
    kind = ordered.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, common = None, None  # the rows of the last key so far, and the key if it is a common one

        def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            key, ids = rows.column("key").to_numpy(), rows.column("id").combine_chunks()
            for i, j in _near(*_told(rows, least), rows.column("before").to_numpy(), np.searchsorted(key, key, side="right")):
                yield pa.record_batch([ids.take(pa.array(i)), ids.take(pa.array(j)), *[pa.nulls(len(i), pa.int64())] * 2], names=["a", "b", "key", "before"])

        def members(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            for part in rows.select(["id", "key", "before"]).to_batches():
                yield pa.record_batch([part.column("id"), *part.columns], names=["a", "b", "key", "before"])

        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = rows.column("key").to_numpy()
            begin = int(np.searchsorted(key, common, side="right")) if common is not None else 0
            yield from members(rows.slice(0, begin))
            last = int(np.searchsorted(key, key[-1]))
            if last > begin:
                yield from pairs(rows.slice(begin, last - begin).combine_chunks())
            held = rows.slice(max(last, begin)).combine_chunks() if begin < len(key) else None
            if held is not None and len(held) > BLOCK:
                common = int(key[-1])
                yield from members(held)
                held = None
        if held is not None:
            yield from pairs(held)

    dealt = _keyed(ordered, "same", least).repartition("key").sortWithinPartitions("key")
    found = cut(dealt.mapInArrow(run, f"a {kind}, b {kind}, key bigint, before bigint").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "key", "before").distinct())
    return found.where("key IS NULL").select("a", "b").unionByName(_met_by_blocks(found.where("key IS NOT NULL").select(F.col("a").alias("id"), "key", "before"), ordered, least))


def _met_by_blocks(members: DataFrame, ordered: DataFrame, least: float) -> DataFrame:
    """(a, b): of the texts of each key, those that may have enough in common by their bits; each two blocks of them are a group."""
    kind = ordered.schema["id"].dataType.simpleString()

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        _, low, high = (k.as_py() for k in key)
        rows = rows.take(pa.array(np.argsort(rows.column("block").to_numpy(), kind="stable")))
        left = int((rows.column("block").to_numpy() == low).sum())
        (need, bits), before, ids = _told(rows, least), rows.column("before").to_numpy(), rows.column("id").combine_chunks()
        found = []
        per = max(1, AT_ONCE // max(1, len(need)))
        for k in range(0, left, per):
            i = np.arange(k, min(k + per, left))
            j = np.arange(left if low < high else k, len(need))
            may = _common((w[i][:, None], w[j]) for w in bits) >= np.maximum(need[i][:, None], need[j])
            may &= (i[:, None] < j) & ((before[i][:, None] != before[j]) | (before[j] < 0))
            x, y = np.nonzero(may)
            found.append((i[x], j[y]))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return pa.table([ids.take(pa.array(i)), ids.take(pa.array(j))], names=["a", "b"])

    n = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = members.join(n, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    placed = placed.join(ordered.select("id", "size", *_BITS).hint("merge"), "id")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    dealt = placed.select("*", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    found = dealt.groupBy("key", "low", "high").applyInArrow(run, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _met_across(ordered: DataFrame, least: float) -> DataFrame:
    """(a, b): texts of different lengths that share a key and may have enough in common by their bits; some come several times."""
    longest = ordered.agg(F.max("size")).first()[0] or 0  # one number
    lower = cut(_keyed(ordered.where(F.col("size") < longest), "lower", least))
    side = lambda rows, s: rows.select(F.col("id").alias(s), F.col("size").alias(f"{s}_size"), *[F.col(w).alias(f"{s}_{w}") for w in _BITS], "key", F.col("before").alias(f"{s}_before"))
    lacks = lambda x, y: sum((F.bit_count(F.col(f"{x}_{w}").bitwiseAND(F.bitwise_not(F.col(f"{y}_{w}")))) for w in _BITS), F.lit(0))
    need = F.ceil(F.lit(least / 2) * (F.col("a_size") + F.col("b_size")) - 1e-9)
    first = (F.col("a_before") != F.col("b_before")) | (F.col("a_before") < 0)
    held = first & (F.col("a_size") < F.col("b_size")) & (F.col("a_size") - lacks("a", "b") >= need) & (F.col("b_size") - lacks("b", "a") >= need)
    few = side(lower, "a").hint("broadcast" if lower.count() <= SENT else "merge")
    return side(_keyed(ordered, "upper", least), "b").join(few, "key").where(held).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _pairs(ordered: DataFrame, least: float) -> DataFrame:
    """(a, b): the ids, each pair once, that meet by what the shorter one's length asks for."""
    return _met_by_key(ordered, least).unionByName(_met_across(ordered, least)).distinct()


def _looked_up(rows: DataFrame, text: str, least: float) -> DataFrame:
    """(a, b): pairs of structs (id, codes) that meet. `rows` has unique `id`s."""
    ordered = cut(_ordered(rows.where(F.length(text) > 0), text))
    known = lambda side: ordered.select(F.struct("id", "codes").alias(f"_{side}"), F.col("id").alias(side))
    return _pairs(ordered, least).join(known("a").hint("merge"), "a").join(known("b").hint("merge"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))


def candidates(rows: DataFrame, text: str, least: float) -> DataFrame:
    """(a, b): pairs of structs (id, codes), a.id < b.id, that may have the ratio `least`. `rows` has unique `id`s."""

    @F.arrow_udf(BooleanType())
    def may_reach(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(in_order.may_reach(a, b, least))

    return _looked_up(rows, text, least).where(may_reach("a.codes", "b.codes"))


def alike(rows: DataFrame, text: str, least: float) -> DataFrame:
    """(a, b): the ids of all pairs, the smaller first, whose texts have an in-order ratio of `least` or more.

    In texts of 200 characters or more very frequent ones of the later text start no match.
    """

    # One function bounds and compares: Spark would put two filters together and compare all pairs.
    @F.arrow_udf(DoubleType())
    def ratio(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(in_order.ratios(a, b, least))

    told = _looked_up(rows, text, least).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), ratio("a.codes", "b.codes").alias("ratio"))
    return told.where(F.col("ratio") >= least).select("a", "b")
