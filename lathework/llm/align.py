r"""Alignment of two tokenizers: which tokens of one meet which of the other, and how often they do corpus-wide.

A is `byte_bpe_50k.json` over blank+text, B `piece_bpe_32k.model` over text, which puts the blank there itself; both tell
bytes. Packed bitsets over the bytes of a group of texts mark where tokens of A and of B end. Their AND holds the shared
cuts. The number of bits set in A's or B's set up to a cut (rank, by counts of bits in bytes) maps cuts to ranges of tokens,
which are the groups, and the token that ends at a cut; a token has one byte at least, so that at each cut one token of A
meets one of B, and that pair of occurrences is a link.

Links are counted over the corpus by blocks, some megabytes of texts that lie together in a partition: a row for each
block and pair of ids with its number, summed by pair in a shuffle with partial sums, the best of each B id beside it;
joined back to blocks' pairs, and sent with a block's documents to the task that sums for each document. A group there is
a block, whose size is bounded; no pair's rows have to meet in one task but as sums, and a join by pair has one row for it
on one side.

Texts are cut into words before blanks and line feeds that stand alone, where both vocabularies begin a token: none of A's
pieces goes on into white space, no piece of B has a blank within, and a line feed is a byte of its own in B. A word that
was seen has its tokens by a look-up. Texts with longer runs of white space at such a place, and those in which a word's
bytes are not those of its tokens, are encoded whole.

Null and empty texts, and those whose tokens' bytes are not blank+text (as with U+2581, which B takes for a blank), have no
tokens and no links. Rows that are equal in id and text are rows of their own. A null doc_id is kept; other columns are
not looked at. A document has to fit a task.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathework.llm.blocks import from_planes, planes
from lathework.llm.common import written

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text, and rows, of a block.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 1 << 14
#: Characters of texts whose tokens are laid side by side at once.
GROUP = 1 << 18
#: Words that a worker remembers, and their characters; beyond, it forgets all and starts anew.
WORDS, CHARACTERS = 400_000, 8_000_000
#: B ids stand in the low bits of a pair.
SHIFT = 20

_MARK = "▁"  # fixed value: stands for a blank in B's pieces
_CROWDED = re.compile(r"[\s\x1c-\x1f][ \n]|[ \n](?:[\s\x1c-\x1f]|\Z)")


def _byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, all others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of many texts, and each id's bytes."""

    def __init__(self, path: str) -> None:
        import public_tokenizers

        path = path if os.sep in path else public_tokenizers.path(path)
        if path.endswith(".json"):
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            model, letters = Tokenizer.from_file(path), _byte_letters()
            model.encode_special_tokens = True
            self.encode = lambda texts: [e.ids for e in model.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
            self.encode_line = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
            own = {t.content for t in model.get_added_tokens_decoder().values()}
            table = {i: t.encode() if t in own else bytes(letters[c] for c in t) for t, i in model.get_vocab().items()}
        else:
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            blank = model.piece_to_id(_MARK)
            # An empty text gets no blank; a blank before a line feed is a token of its own.
            self.encode = lambda texts: [i or [blank] for i in model.encode(texts, num_threads=1)]
            self.encode_line = lambda texts: [i[1:] for i in model.encode(texts, num_threads=1)]
            table = {i: bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))}
        self.bytes = [table.get(i, b"") for i in range(max(table) + 1)]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)


class _Known(dict):
    """Word to its number; new words are put on a list."""

    def __init__(self) -> None:
        self.new: list[str] = []
        self.characters = 0

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        self.characters += len(word)
        return n


class Store:
    """Short lists of numbers one after another, to be gathered by the lists' numbers."""

    def __init__(self) -> None:
        self.values, self.at, self.known = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def add(self, lists: list[list[int]]) -> None:
        n, sizes = self.known + len(lists), np.fromiter(map(len, lists), np.int64, len(lists))
        while len(self.at) <= n:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        first = self.at[self.known]
        self.at[self.known + 1 : n + 1] = first + np.cumsum(sizes)
        while len(self.values) < self.at[n]:
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[first : self.at[n]] = [i for x in lists for i in x]
        self.known = n

    def gathered(self, numbers: np.ndarray) -> np.ndarray:
        begin, size = self.at[numbers], self.at[numbers + 1] - self.at[numbers]
        last = np.cumsum(size)
        return self.values[np.arange(int(last[-1]) if len(last) else 0) + np.repeat(begin - (last - size), size)]


class Pair:
    """Both tokenizers over many texts; words are encoded once."""

    def __init__(self, a: str, b: str) -> None:
        self.sides = (Side(a), Side(b))
        self._forget()

    def _forget(self) -> None:
        self.words, self.stores, self.sound = _Known(), (Store(), Store()), np.zeros(0, bool)

    def _learn(self) -> None:
        new, self.words.new = self.words.new, []
        if not new:
            return
        lines = [i for i, w in enumerate(new) if w.startswith("\n")]
        others = [i for i, w in enumerate(new) if not w.startswith("\n")]
        sound = np.ones(len(new), bool)
        for side, store in zip(self.sides, self.stores, strict=True):
            made: list[list[int]] = [[]] * len(new)
            for at, encode in ((lines, side.encode_line), (others, side.encode)):
                for i, ids in zip(at, encode([new[i] for i in at]), strict=True):
                    made[i] = ids
            store.add(made)
            for i, ids in enumerate(made):
                sound[i] &= b"".join([side.bytes[k] for k in ids]) == (new[i] if new[i].startswith("\n") else f" {new[i]}").encode()
        self.sound = np.concatenate((self.sound, sound))

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of A and of B of each text; None for one that has no tokens."""
        if len(self.words) > WORDS or self.words.characters > CHARACTERS:
            self._forget()
        numbered: list[np.ndarray | None] = []
        for text in texts:
            words = None if not text or _CROWDED.search(f" {text}") else text.replace("\n", " \n").split(" ")
            numbered.append(words and np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
        self._learn()
        return [None if not t else self._whole(t) if n is None or not self.sound[n].all() else tuple(s.gathered(n) for s in self.stores) for t, n in zip(texts, numbered, strict=True)]

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        ids = [side.encode([text])[0] for side in self.sides]
        want = f" {text}".encode()
        if any(b"".join([side.bytes[k] for k in own]) != want for side, own in zip(self.sides, ids, strict=True)):
            return None
        return tuple(np.array(own, np.int64) for own in ids)


_pairs: dict[tuple[str, str], Pair] = {}


def pair(a: str, b: str) -> Pair:
    """A worker's two tokenizers, made once."""
    if (a, b) not in _pairs:
        _pairs[a, b] = Pair(a, b)
    return _pairs[a, b]


def _packed(ends: np.ndarray, size: int) -> np.ndarray:
    marks = np.zeros(size, bool)
    marks[ends - 1] = True
    return np.packbits(marks)


def _rank(bits: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many bits are set up to each cut, the cut's own bit included."""
    before = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))
    byte, rest = (cuts - 1) >> 3, (cuts - 1) & 7
    return before[byte] + np.bitwise_count(bits[byte] >> (7 - rest).astype(np.uint8))


def cuts(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets where tokens of both sides end, and how many tokens of A and of B there are up to each."""
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    if not len(a_ends):
        return (np.zeros(0, np.int64),) * 3
    size = int(a_ends[-1])
    a_bits, b_bits = _packed(a_ends, size), _packed(b_ends, size)
    shared = np.flatnonzero(np.unpackbits(a_bits & b_bits, count=size)) + 1
    return shared, _rank(a_bits, shared), _rank(b_bits, shared)


def _told(table: np.ndarray, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> bytes:
    """`a1,a2|b1;a3|b2,b3`; `table` has ids with a comma, with a bar and with a semicolon."""
    n, groups = len(table) // 3, np.arange(len(a_last))
    a_size, b_size = np.diff(a_last, prepend=0), np.diff(b_last, prepend=0)
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + np.repeat(b_last - b_size, a_size)] = a
    codes[np.arange(len(b)) + np.repeat(a_last, b_size)] = b
    codes[a_last - 1 + b_last - b_size] += n
    codes[a_last + b_last - 1] += 2 * n
    return b"".join(table[codes].tolist())[:-1] if len(groups) else b""


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_ARRAYS = ("a_ids", "b_ids", "a_last", "b_last")


def _aligned(a: str, b: str, keep: bool):
    """Batches (doc_id, text) to rows of documents, and after each block a row with its pairs and their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, task, block = pair(a, b), TaskContext.get().partitionId(), 0
        sizes = [s.sizes for s in both.sides]
        most = max(map(len, sizes))
        table = np.array([f"{i}{c}".encode() for c in ",|;" for i in range(most)], object)
        ids: list[pa.Array] = []
        rows: list[tuple] = []
        links: list[np.ndarray] = []
        held = 0

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal ids, rows, links, held, block
            name = task << 32 | block
            joined = np.concatenate(links)
            pairs, at, n = np.unique(joined, return_inverse=True, return_counts=True)
            edge = np.cumsum([len(x) for x in links])
            packed = []  # how many distinct pairs a document has, the length of the first part, and the pairs' places and numbers
            for own in np.split(at, edge[:-1]):
                k, m = np.unique(own, return_counts=True)
                places = planes(np.diff(k, prepend=0))
                packed.append((len(k), len(places), places + planes(m)))
            arrays = [pa.array(x, pa.int64()) for x in list(zip(*rows, strict=True))[:4]]
            text = pa.array([r[4] for r in rows], pa.string())
            tail = [pa.array(x, t) for x, t in zip(zip(*packed, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)]
            extra = [pa.array([r[5][k] for r in rows], pa.list_(pa.int32())) for k in range(len(_ARRAYS))] if keep else []
            none = [pa.nulls(len(rows), pa.list_(pa.int64()))] * 2
            names = ["block", "doc_id", *_NUMBERS, "groups_sha256", *(_ARRAYS if keep else ()), "distinct", "cut", "links", "pairs", "numbers"]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), name), pa.int64()), pa.concat_arrays(ids), *arrays, text, *extra, *tail, *none], names=names)
            one = [pa.array([name], pa.int64()), pa.nulls(1, ids[0].type), *[pa.nulls(1, x.type) for x in (*arrays, text, *extra, *tail)], pa.array([pairs], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(one, names=names)
            ids, rows, links, held, block = [], [], [], 0, block + 1

        for batch in batches:
            texts, begin, size = batch.column(1).to_pylist(), 0, 0
            for k, text in enumerate(texts):
                size += len(text or "")
                if size < GROUP and k + 1 < len(texts):
                    continue
                found = both.encode(texts[begin : k + 1])
                none = np.zeros(0, np.int64)
                tokens = [f or (none, none) for f in found]
                a_ids, b_ids = (np.concatenate([t[s] for t in tokens]) for s in (0, 1))
                _, a_last, b_last = cuts(sizes[0][a_ids], sizes[1][b_ids])
                linked = a_ids[a_last - 1] << SHIFT | b_ids[b_last - 1]
                a_at, b_at = (np.cumsum([0, *(len(t[s]) for t in tokens)]) for s in (0, 1))
                edge = np.searchsorted(a_last, a_at, side="right")
                for i, (x, y) in enumerate(tokens):
                    p, q = edge[i : i + 2]
                    own_a, own_b = a_last[p:q] - a_at[i], b_last[p:q] - b_at[i]
                    sha = hashlib.sha256(_told(table, x, y, own_a, own_b)).hexdigest() if len(x) else ""
                    rows.append((len(x), len(y), q - p, q - p, sha, *([[v.astype(np.int32) for v in (x, y, own_a, own_b)]] if keep else [])))
                    links.append(linked[p:q])
                ids.append(batch.column(0).slice(begin, k + 1 - begin))
                held += size
                begin, size = k + 1, 0
                if held >= BLOCK_BYTES or len(rows) >= BLOCK_ROWS:
                    yield from ended()
        if rows:
            yield from ended()

    return run


def _summed(keep: bool):
    """The documents of a block and the counts of its pairs to the documents' sums."""
    names = ["doc_id", *_NUMBERS, "groups_sha256", *(_ARRAYS if keep else ())]

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        order = np.argsort(counts["pair"].to_numpy())
        n, best = counts["n"].to_numpy()[order], counts["best"].to_numpy()[order]
        sums = []
        for distinct, cut, data in zip(*(docs[c].to_pylist() for c in ("distinct", "cut", "links")), strict=True):
            k = np.cumsum(from_planes(data[:cut], distinct).astype(np.int64))
            m = from_planes(data[cut:], distinct).astype(np.int64)
            sums.append((int((m * best[k]).sum()), int((m * n[k]).sum())))
        out = docs.select(names)
        for c, v in zip(("n_best", "count_sum"), zip(*sums, strict=True), strict=True):
            out = out.append_column(c, pa.array(v, pa.int64()))
        return out

    return run


def align(docs: DataFrame, a: str = BYTES, b: str = PIECES, keep: bool = True) -> DataFrame:
    """A row for each document: how many tokens, groups and links, how many links are of the best A id of their B id, and the sum of links' counts.

    With `keep` the ids of both sides come along, and how many tokens of each there are up to the end of each group; the
    link of a group is its last token of each side.
    """
    kind = dict(docs.dtypes)["doc_id"]
    own = [("doc_id", kind), *[(n, "bigint") for n in _NUMBERS], ("groups_sha256", "string"), *[(n, "array<int>") for n in _ARRAYS if keep]]
    schema = lambda columns: ", ".join(f"{n} {t}" for n, t in columns)
    inner = [("block", "bigint"), *own, ("distinct", "bigint"), ("cut", "bigint"), ("links", "binary"), ("pairs", "array<bigint>"), ("numbers", "array<bigint>")]
    blocks = written(docs.select("doc_id", "text").mapInArrow(_aligned(a, b, keep), schema(inner)), "aligned")
    pairs = blocks.where("pairs is not null").select(F.col("block").alias("home"), F.explode(F.arrays_zip("pairs", "numbers")).alias("p")).select("home", F.col("p.pairs").alias("pair"), F.col("p.numbers").alias("n"))
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND((1 << SHIFT) - 1))
    counts = written(counts, "pair-counts")
    best = counts.groupBy("b").agg(F.max("n").alias("most"))
    rated = counts.join(best.hint("merge"), "b").select("pair", "n", (F.col("n") == F.col("most")).cast("bigint").alias("best"))
    answers = pairs.select("home", "pair").join(rated.hint("merge"), "pair").select("home", "pair", "n", "best")
    rows = blocks.where("pairs is null").drop("pairs", "numbers")
    return rows.groupBy("block").cogroup(answers.groupBy("home")).applyInArrow(_summed(keep), schema([*own, ("n_best", "bigint"), ("count_sum", "bigint")]))
