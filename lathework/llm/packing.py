"""Best-fit packing of token sequences, after a Martello-Toth dominance reduction.

Documents become pieces of at most `size` tokens. All that a packing has to know of a piece is its length, so the plan is
made on the histogram of lengths: at most `size` numbers however many documents there are. The reduction fixes, for a
length l, sets that dominate every other set with l: l alone if nothing fits beside it; l with the longest length k that
fits, if no other lengths that fit beside l add up to more than k (exact pairs above all). It is repeated on the smaller
instance until nothing changes; best-fit decreasing packs the rest, taking equal pieces and equal bins together.

The plan maps (length, rank of the piece among those of its length) to a sequence and an offset. Its entries are bounded
by the lengths and not by the documents; pieces get their rank from counts by (task, length), so no length meets in one
task, and each finds its place by a search in the plan.

Defined cases: null or empty text is a document of its end id alone; a null doc_id is kept; repeated rows are packed each;
an empty table gives an empty table; other columns are dropped (`doc_id` and `text` name the two that are read).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathework.llm.common import written
from lathework.llm.tokens import encoder

SIZE = 1024
#: Tasks whose counts by length, of some 16 bytes for each length, may be broadcast; those of more meet their pieces by a shuffle.
BROADCAST_TASKS = 2000


@dataclass(frozen=True)
class Entry:
    """Pieces of `length` with ranks from `rank` on: `each` of them in each of `bins` sequences from `sequence` on, at `offset`."""

    length: int
    rank: int
    bins: int
    each: int
    sequence: int
    offset: int


class _Planner:
    def __init__(self, counts: dict[int, int], size: int) -> None:
        self.size, self.left = size, {k: v for k, v in counts.items() if v}
        self.ranks = dict.fromkeys(counts, 0)
        self.sequences = 0
        self.entries: list[Entry] = []

    def put(self, length: int, bins: int, each: int, sequence: int, offset: int) -> None:
        self.entries.append(Entry(length, self.ranks[length], bins, each, sequence, offset))
        self.ranks[length] += bins * each
        self.left[length] -= bins * each
        if not self.left[length]:
            del self.left[length]

    def fix(self, lengths: list[int], bins: int) -> None:
        """`bins` new sequences that hold `lengths` and nothing else."""
        offset = 0
        for length in dict.fromkeys(lengths):
            each = lengths.count(length)
            self.put(length, bins, each, self.sequences, offset)
            offset += each * length
        self.sequences += bins

    def reach(self, room: int, without: int) -> int:
        """The largest sum of at most `room` of the pieces left, one of length `without` put aside."""
        sums, mask = 1, (1 << (room + 1)) - 1
        for length, n in self.left.items():
            n = min(n - (length == without), room // length)
            step = 1
            while n > 0:  # multiples by doubling
                take = min(step, n)
                sums |= sums << (take * length) & mask
                n -= take
                step *= 2
            if sums >> room & 1:
                return room
        return sums.bit_length() - 1

    def reduce(self) -> None:
        changed = True
        while changed:
            changed = False
            for length in sorted(self.left, reverse=True):
                while n := self.left.get(length, 0):
                    room = self.size - length
                    fits = [k for k, m in self.left.items() if k <= room and (k != length or m > 1)]
                    if not fits:
                        self.fix([length], n)
                    elif (k := max(fits)) == room or self.reach(room, length) == k:
                        self.fix([length, k], n // 2 if k == length else min(n, self.left[k]))
                    else:
                        break
                    changed = True

    def best_fit(self) -> None:
        """Longest first, each into the open sequence with the least room that suffices."""
        open_bins: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)
        for length in sorted(self.left, reverse=True):
            while n := self.left.get(length, 0):
                room = min((r for r in open_bins if r >= length), default=None)
                if room is None:
                    room = self.size
                    bins = -(-n // (room // length))
                    first, self.sequences = self.sequences, self.sequences + bins
                else:
                    first, bins = open_bins[room].pop()
                    if not open_bins[room]:
                        del open_bins[room]
                each = room // length
                full = min(bins, n // each)
                rest = n - full * each if full < bins else 0
                for at, many, k in ((first, full, each), (first + full, 1, rest)):
                    if many and k:
                        self.put(length, many, k, at, self.size - room)
                        open_bins.setdefault(room - k * length, []).append((at, many))
                used = full + bool(rest)
                if used < bins:
                    open_bins.setdefault(room, []).append((first + used, bins - used))


def plan(counts: dict[int, int], size: int = SIZE) -> list[Entry]:
    """Places for `counts[length]` pieces of each length from 1 to `size`."""
    p = _Planner(counts, size)
    p.reduce()
    p.best_fit()
    return p.entries


def _pieces(tokenizer: str, end: int, size: int, keep_ids: bool):
    """Batches (doc_id, text) to pieces, with the task that made them and their rank there among pieces of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer).encode, TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            docs = batch.column(0)
            rows, out = [], {k: [] for k in ("piece", "start", "length", "ids_crc32", "rank", "ids")}

            def made() -> pa.RecordBatch:
                columns = [docs.take(pa.array(rows, pa.int64())), *[pa.array(out[k], pa.int64()) for k in ("piece", "start", "length", "ids_crc32", "rank")]]  # noqa: B023
                if keep_ids:
                    columns.append(pa.array(out["ids"], pa.binary()))  # noqa: B023
                columns.append(pa.array(np.full(len(rows), task), pa.int64()))  # noqa: B023
                return pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "rank", *["ids"] * keep_ids, "task"])

            held = 0
            for row, ids in enumerate(encode(batch.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append(row)
                    data = ids[a:b].tobytes()
                    for name, value in (("piece", k), ("start", a), ("length", b - a), ("ids_crc32", zlib.crc32(data)), ("rank", int(seen[b - a]))):
                        out[name].append(value)
                    seen[b - a] += 1
                    if keep_ids:
                        out["ids"].append(data)
                        held += len(data)
                if held > 8 << 20:
                    yield made()
                    rows, out, held = [], {k: [] for k in out}, 0
            yield made()

    return run


def _placed(entries: list[Entry], size: int):
    """Batches with length and rank to batches with sequence_id and offset in their stead."""
    entries = sorted(entries, key=lambda e: (e.length, e.rank))
    length, rank, each, sequence, offset = (np.array([getattr(e, k) for e in entries], np.int64) for k in ("length", "rank", "each", "sequence", "offset"))
    begin = np.searchsorted(length, np.arange(size + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, r = (batch.column(k).to_numpy() for k in ("length", "rank"))
            at = np.empty(len(n), np.int64)
            for k in np.unique(n):
                a, b = begin[k], begin[k + 1]
                mine = n == k
                at[mine] = a + np.searchsorted(rank[a:b], r[mine], side="right") - 1
            past = r - rank[at] if len(n) else r
            found = batch.drop_columns(["rank"])
            found = found.append_column("sequence_id", pa.array(sequence[at] + past // each[at] if len(n) else n, pa.int64()))
            yield found.append_column("offset", pa.array(offset[at] + past % each[at] * n if len(n) else n, pa.int64()))

    return run


def pack(docs: DataFrame, tokenizer: str, end: int, size: int = SIZE, keep_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and its ids as little-endian unsigned 32-bit."""
    kind = dict(docs.dtypes)["doc_id"]
    numbers = ("piece", "start", "length", "ids_crc32")
    ids = [("ids", "binary")] * keep_ids
    made = [("doc_id", kind), *[(n, "bigint") for n in numbers], ("rank", "bigint"), *ids, ("task", "bigint")]
    schema = lambda columns: ", ".join(f"{n} {t}" for n, t in columns)
    pieces = written(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, end, size, keep_ids), schema(made)), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.select("task", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "piece-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `size` rows
    entries = plan(histogram, size)
    # A row for each task: how many pieces of each length the tasks before it have.
    bases = written(counts.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("length", "base"))).alias("bases")), "piece-bases")
    bases = F.broadcast(bases) if bases.count() <= BROADCAST_TASKS else bases.hint("merge")
    ranked = pieces.join(bases, "task").withColumn("rank", F.col("rank") + F.element_at("bases", F.col("length")))
    keep = [n for n, _ in made if n not in ("rank", "task")]
    out = [(n, t) for n, t in made if n in keep] + [("sequence_id", "bigint"), ("offset", "bigint")]
    return ranked.select(*keep, "rank").mapInArrow(_placed(entries, size), schema(out))
