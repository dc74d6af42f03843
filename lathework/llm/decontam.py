r"""Benchmark decontamination by winnowing.

Texts become arrays of word hashes. Every run of K words has a hash, and of each W consecutive ones the least (the
leftmost of equals) is a fingerprint, so two texts that share K + W - 1 words in a row share a fingerprint inside them, at
the same place. Fingerprints of documents and items are joined, and each hit is extended word by word to both sides
within the window's reach: if the equal run has WINDOW words, its words are hit. Items shorter than a window are one
window of their own length; for each such length that occurs (nine at most), documents give the hashes of all their runs
of it, in the same pass.

The benchmark's fingerprints, and the ids of documents hit, are broadcast only if a count finds them few; otherwise the
joins shuffle, and documents without any hit are put aside by a semi join on bare fingerprints first.

Defined cases: null or empty text has no words; items without id are ignored, repeated ones count once; rows are told
apart by (doc_id, text), so repeated rows get equal results; an empty benchmark hits nothing; other columns are dropped
by `find_hits` and carried along by `decontaminate`.

Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.llm.common import free_name, let, written

WINDOW, K = 10, 5
W = WINDOW - K + 1
#: Fingerprints of the benchmark, of some 200 bytes each, or ids of documents hit, that may be broadcast.
BROADCAST_ROWS = 100_000
#: What separates words, before capitals become small letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_letters(text: Column) -> Column:
    """A-Z in small letters, all else as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _CAPITALS, _SMALL))


def words(text: Column) -> Column:
    return F.filter(F.split(small_letters(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")).cast("bigint")


FINGERPRINT = "struct<size int, fp bigint, at int, left int, near array<bigint>>"
#: The lower half of a run's value is its place, the upper half that of its hash.
_PLACE = (1 << 32) - 1


def _fingerprints(w: Column) -> Column:
    """Winnowed fingerprints of an array of word hashes, with the words near them that a window can reach."""
    reach = WINDOW - K

    def near(p: Column, h: Column) -> Column:
        left = F.least(p, F.lit(reach))
        return F.struct(F.lit(WINDOW).alias("size"), h[p].alias("fp"), p.alias("at"), left.alias("left"), F.slice(w, p - left + 1, left + K + reach).alias("near"))

    def paired(a: Column, b: Column, step: int) -> Column:
        # The least of each element and the one `step` further on; past the end there is none.
        return F.zip_with(a, F.slice(b, step + 1, F.size(b)), lambda x, y: F.least(x, y))

    def chosen(h: Column) -> Column:
        # Upper half of the hash, then the place: the least is the leftmost of equals. Windows by doubling: 2, 4, then W.
        values = F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("bigint")))
        windows = let(let(values, lambda v: paired(v, v, 1)), lambda two: paired(paired(two, two, 2), two, W - 2))
        at = F.transform(F.slice(windows, 1, F.size(h) - W + 1), lambda x: x.bitwiseAND(F.lit(_PLACE)).cast("int"))
        return F.transform(F.array_distinct(at), lambda p: near(p, h))

    runs = F.transform(F.sequence(F.lit(0), F.size(w) - K), lambda i: F.xxhash64(*[w[i + j] for j in range(K)]))
    return F.when(F.size(w) >= WINDOW, let(runs, chosen)).otherwise(F.array().cast(f"array<{FINGERPRINT}>"))


def _runs(w: Column, length: int) -> Column:
    """All runs of `length` words, in the form of fingerprints."""
    every = F.transform(
        F.sequence(F.lit(0), F.size(w) - length),
        lambda i: let(F.slice(w, i + 1, length), lambda s: F.struct(F.lit(length).alias("size"), F.xxhash64(s).alias("fp"), i.alias("at"), F.lit(0).alias("left"), s.alias("near"))),
    )
    return F.when(F.size(w) >= length, every).otherwise(F.array().cast(f"array<{FINGERPRINT}>"))


def _marks(rows: DataFrame, short: list[int], own: bool = False) -> DataFrame:
    """A row for each fingerprint of `rows`, which have an array of word hashes `w`: in one pass for windows and all lengths in `short`.

    With `own`, a row's runs are of its own number of words alone, as an item's.
    """
    runs = lambda w, n: F.when(F.size(w) == n, _runs(w, n)).otherwise(F.array().cast(f"array<{FINGERPRINT}>")) if own else _runs(w, n)
    made = let(F.col("w"), lambda w: F.concat(_fingerprints(w), *[runs(w, n) for n in short]))
    keep = [c for c in rows.columns if c != "w"]
    return rows.select(*keep, F.inline(made))


def _extended() -> tuple[Column, Column, Column]:
    """First and last + 1 hit word of a joined pair of fingerprints of one size, and whether they make a window."""

    def run(a: str, b: str, step: int) -> Column:
        # Words equal from the fingerprint outwards.
        first = {-1: lambda left: F.col(left) - 1, 1: lambda left: F.col(left) + K}[step]

        def more(n: Column, j: Column) -> Column:
            same = F.get(F.col(a), first("left") + step * j) == F.get(F.col(b), first("item_left") + step * j)
            return F.when((n == j) & F.coalesce(same, F.lit(False)), n + 1).otherwise(n)

        return F.aggregate(F.sequence(F.lit(0), F.lit(WINDOW - K - 1)), F.lit(0), more)

    left, right = run("near", "item_near", -1), run("near", "item_near", 1)
    same = F.slice("near", F.col("left") + 1, K) == F.slice("item_near", F.col("item_left") + 1, K)
    short = F.col("size") < WINDOW
    holds = F.when(short, F.col("near") == F.col("item_near")).otherwise(same & (left + right + K >= WINDOW))
    return F.when(short, F.col("at")).otherwise(F.col("at") - left), F.when(short, F.col("at") + F.col("size")).otherwise(F.col("at") + K + right), holds


def _few(rows: DataFrame) -> DataFrame:
    """Written `rows`, broadcast if a count finds them few; else a shuffle meets them, which splits a frequent key."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows.hint("merge")


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Hit ranges of words: (doc_id, text_hash, item_id, first, last), `last` exclusive."""
    hashed = lambda t: F.transform(words(F.col(t)), lambda w: F.xxhash64(w))
    items = written(benchmark.where(F.col("item_id").isNotNull()).select("item_id", hashed("text").alias("w")).where(F.size("w") > 0).distinct(), "benchmark")
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), hashed(text).alias("w"))
    short = sorted(r[0] for r in items.where(F.size("w") < WINDOW).select(F.size("w")).distinct().collect())  # nine at most
    marks = written(_marks(items, short, own=True).select("item_id", "size", "fp", F.col("left").alias("item_left"), F.col("near").alias("item_near")), "fingerprints")
    theirs, few = _marks(rows, short), _few(marks)
    if marks.count() > BROADCAST_ROWS:
        # Bare fingerprints first: the words near them travel for documents alone that share one with an item.
        hit = theirs.select("doc_id", "text_hash", "size", "fp").join(marks.select("size", "fp").distinct().hint("merge"), ["size", "fp"], "left_semi")
        hit = written(hit.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct(), "hit-documents")
        theirs = _marks(rows.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left_semi"), short)
    first, last, holds = _extended()
    return theirs.join(few, ["size", "fp"]).where(holds).select("doc_id", "text_hash", "item_id", first.cast("int").alias("first"), last.cast("int").alias("last"))


def _covered(ranges: Column) -> Column:
    """Words in the union of sorted ranges."""

    def add(a: Column, r: Column) -> Column:
        begin = F.greatest(a["end"], r["first"])
        return F.struct((a["n"] + F.greatest(r["last"] - begin, F.lit(0))).alias("n"), F.greatest(a["end"], r["last"]).alias("end"))

    return F.aggregate(F.sort_array(ranges), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), add)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, text_hash, n_words, n_hit and the ids of the items that occur in it, sorted as strings."""
    by = ["doc_id", "text_hash"]
    hits = (
        find_hits(docs, benchmark, text)
        .groupBy(*by)
        .agg(F.collect_set(F.struct("first", "last")).alias("ranges"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
        .select(*[F.col(c).alias(f"h_{c}") for c in by], _covered(F.col("ranges")).cast("bigint").alias("hit"), "items")
    )
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), n_words(F.col(text)).alias("n_words"))
    joined = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("h_doc_id")) & (F.col("text_hash") == F.col("h_text_hash")), "left")
    return joined.select(*by, "n_words", F.coalesce("hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` in which no window of the benchmark occurs."""
    hit_id, hit_hash = free_name(docs, "hit_id"), free_name(docs, "hit_hash")
    hits = written(find_hits(docs, benchmark, text).select(F.col("doc_id").alias(hit_id), F.col("text_hash").alias(hit_hash)).distinct(), "hits")
    return docs.join(_few(hits), F.col("doc_id").eqNullSafe(F.col(hit_id)) & (F.xxhash64(text) == F.col(hit_hash)), "left_anti")


def decontamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
