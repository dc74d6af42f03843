"""Fingerprints of documents by one-permutation MinHash, in built-in expressions only.

Each distinct run of five words (A-Z lower-cased; the whole sequence where there are fewer) is hashed once. The hash's high
bits name a bin, and a bin keeps its least hash. Hashes and one ceiling for each bin are sorted together, so that the first
of each bin is what it keeps, and an empty bin shows its own ceiling.

Optimal densification: an empty bin takes the value of another one, found by probing bins in an order of its own (a hash of
the bin's and the probe's number) until one is full; bins that are empty in two texts alike probe alike. After PROBES tries
the full bin with the least hash beside the empty one's number is taken, so every bin of a text with a word gets a value. A
value that was taken is hashed once more with the number of the bin it fills: bins that share a donor then agree by chance
one by one and not all together.

The low-order `bits` of each bin are packed into 64-bit integers. Two texts whose shingles have likeness R agree in a bin
with R + (1 - R) / 2**bits, so R is estimated as (agreeing / bins - 2**-bits) / (1 - 2**-bits), and at least 0.

Nulls and texts without words have the fingerprint null (as a string: ''), which is fully like itself and not like any other.
Equal texts have equal fingerprints. The next document is by descending doc_id, those of one id by descending hash of the
text, null ids last; rows equal in id and text are one document that is returned as often as it is there. A single document
is its own next one. Other columns are not looked at. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.llm.common import SPACE, let, written

BINS, BITS, WORDS = 256, 4, 5
#: Tries by number before an empty bin looks at all full ones.
PROBES = 6


def _shingles(words: Column, n: int) -> Column:
    """Hashes of runs of `n` words; of the whole sequence if there are fewer."""

    def runs(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - n)
        return F.when(F.size(w) < n, F.array(F.xxhash64(F.lit(len("short")), F.array_join(w, " ")))).otherwise(
            F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))
        )

    return let(words, runs)


def _dense(kept: Column, bins: int, shift: int) -> Column:
    """A value for each bin, from the array of each bin's least hash (a bin's ceiling: it is empty)."""
    low = F.lit((1 << shift) - 1).cast("bigint")
    empty = lambda h: h.bitwiseAND(low) == low

    def filled(slots: Column) -> Column:
        """`slots` has null for an empty bin."""
        numbered = F.filter(F.transform(slots, lambda v, k: F.struct(k.alias("k"), v.alias("v"))), lambda s: s["v"].isNotNull())

        def each(full: Column) -> Column:
            def value(v: Column, k: Column) -> Column:
                probes = [F.get(slots, F.pmod(F.xxhash64(k, F.lit(t)), F.lit(bins)).cast("int")) for t in range(PROBES)]
                last = F.array_min(F.transform(full, lambda s: F.struct(F.xxhash64(k, s["k"], F.lit(PROBES)).alias("h"), s["v"].alias("v"))))["v"]
                return F.coalesce(v, F.xxhash64(F.coalesce(*probes, last), k))

            return F.transform(slots, value)

        return let(numbered, each)

    return let(F.transform(kept, lambda h: F.when(~empty(h), h)), filled)


def fingerprint(text: Column, bins: int = BINS, bits: int = BITS, n: int = WORDS) -> Column:
    """The packed low-order bits of all bins as 64-bit integers, bins in order from high to low bits; null without words.

    `bins` is a power of two, `bits` divides 64, and together they fill whole integers.
    """
    shift, each = 64 - bins.bit_length() + 1, 64 // bits
    if bins & (bins - 1) or 64 % bits or bins % each:
        raise ValueError("bins has to be a power of two, bits to divide 64, and bins * bits to be a multiple of 64")
    ceilings = F.transform(F.sequence(F.lit(-(bins // 2)), F.lit(bins // 2 - 1)), lambda k: F.shiftleft(k.cast("bigint"), shift).bitwiseOR(F.lit((1 << shift) - 1).cast("bigint")))
    small = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(small, f"{SPACE}+"), lambda w: w != "")
    of = lambda h: F.shiftright(h, shift)

    def least(h: Column) -> Column:
        return F.filter(h, lambda v, i: (i == 0) | (of(v) != of(F.get(h, i - 1))))

    def packed(values: Column) -> Column:
        one = F.lit((1 << bits) - 1).cast("bigint")
        fold = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda a, v: F.shiftleft(a, bits).bitwiseOR(v.bitwiseAND(one)))
        return F.transform(F.sequence(F.lit(0), F.lit(bins // each - 1)), lambda k: fold(F.slice(values, k * each + 1, each)))

    def whole(w: Column) -> Column:
        kept = let(F.array_sort(F.concat(_shingles(w, n), ceilings)), least)
        return F.when(F.size(w) > 0, let(_dense(kept, bins, shift), packed))

    return let(words, whole)


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """The estimated share of common shingles of two texts by their fingerprints, from 0 to 1; 1 for two without words, 0 for one."""
    ones = F.lit(sum(1 << k for k in range(0, 64, bits)) - (1 << 64 if bits == 1 else 0)).cast("bigint")

    def differing(x: Column) -> Column:
        """How many groups of `bits` bits of an integer are not zero."""
        step = 1
        while step < bits:
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
            step *= 2
        return F.bit_count(x.bitwiseAND(ones))

    apart = sum((differing(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(bins * bits // 64)), F.lit(0))
    chance = 2.0**-bits
    estimate = F.greatest(F.lit(0.0), (1.0 - apart / float(bins) - chance) / (1.0 - chance))
    return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNull()).cast("double")).otherwise(estimate)


def hexadecimal(packed: Column) -> Column:
    """A fingerprint as a string, '' for null."""
    return F.coalesce(F.array_join(F.transform(packed, lambda v: F.lpad(F.lower(F.hex(v)), 16, "0")), ""), F.lit(""))


def in_turn(rows: DataFrame, order: list[Column]) -> DataFrame:
    """`rows` with `number`, 0 for the first, and `among`, how many there are: a distributed sort, and one row for each of its partitions counted."""
    ordered = written(rows.orderBy(*order).withColumn("number", F.monotonically_increasing_id()), "ordered")
    task = F.shiftright("number", 33)
    sizes = ordered.groupBy(task.alias("task")).agg(F.count("*").alias("n"))
    # As many rows as the sort had partitions: a bound that does not grow with the data.
    before = sizes.select("task", *[F.coalesce(F.expr(f"sum(n) over ({w})"), F.lit(0)).alias(c) for c, w in (("base", "order by task rows between unbounded preceding and 1 preceding"), ("among", ""))])
    numbered = ordered.join(F.broadcast(before), task == F.col("task"))
    return numbered.withColumn("number", F.col("base") + F.col("number").bitwiseAND((1 << 33) - 1)).drop("base", "task")


def fingerprints(docs: DataFrame, column: str = "fingerprint", text: str = "text", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """`docs` with the fingerprint of their texts; a column of that name is replaced."""
    return docs.withColumn(column, fingerprint(F.col(text), bins, bits))


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, whose later half comes from the next document's beginning.

    Only ids and lengths are sorted. A document's beginning goes to the one before it, cut to what that one takes, and
    fingerprints are met with the next document's once they are made, so no text is moved more than twice.
    """
    docs = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    distinct = docs.select("id", "mark", F.length("text").alias("n_chars")).groupBy("id", "mark").agg(F.max("n_chars").alias("n_chars"))
    turns = written(in_turn(distinct, [F.col("id").desc_nulls_last(), F.col("mark").desc()]), "turns")
    mine = turns.select("id", "mark", "n_chars", "number", ((F.col("number") + 1) % F.col("among")).alias("next"))
    taker = mine.select(F.col("next").alias("number"), F.col("id").alias("to_id"), F.col("mark").alias("to_mark"), F.floor(F.col("n_chars") / 2).cast("int").alias("half"))
    givers = turns.select("id", "mark", "number").join(taker.hint("merge"), "number").drop("number")
    both = lambda a, b, pairs: [F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{y}")) for x, y in pairs]
    given = docs.alias("d").join(givers.hint("merge").alias("g"), both("d", "g", [("id", "id"), ("mark", "mark")]))
    given = given.select("to_id", "to_mark", F.substring(F.col("text"), F.lit(1), F.col("half")).alias("head"))
    given = given.groupBy("to_id", "to_mark").agg(F.max("head").alias("head"))  # copies of one document give the same
    texts = docs.alias("d").join(given.hint("merge").alias("g"), both("d", "g", [("id", "to_id"), ("mark", "to_mark")])).select("id", "mark", "text", "head")
    n_chars = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n_chars - F.floor(n_chars / 2).cast("int")), F.col("head"))
    made = texts.select("id", "mark", n_chars.cast("bigint").alias("n_chars"), F.col("text").alias("own"), edited.alias("edited"))
    made = made.select("id", "mark", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("own")).alias("own"), fingerprint(F.col("edited")).alias("edited"))
    made = written(made, "fingerprints")
    placed = made.alias("m").join(mine.hint("merge").alias("t"), both("m", "t", [("id", "id"), ("mark", "mark")])).select("m.*", "t.number", "t.next")
    others = placed.groupBy("number").agg(F.first("own").alias("following")).withColumnRenamed("number", "next")
    met = placed.join(others.hint("merge"), "next")
    return met.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", hexadecimal(F.col("own")).alias("fingerprint"), hexadecimal(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
