"""Quality rules as a short-circuit cascade: the rule that rejects most per unit of cost comes first.

A rule is true of a document that fails, and reads measures of its text. On a bounded sample each rule's cost (the steps of
its measures not yet taken: characters read by patterns, elements made, comparisons of sorts, counted for each text) and
selectivity (share of what is left that it rejects) are estimated; the rules then stand in one expression in descending order of rejection per cost, so a document
that fails an early rule never pays for a later one, and no measure is taken twice. The order changes the work, not the
verdict: a document is kept when no rule rejects it.

Defined cases: null text has no words and fails; empty text likewise; other columns are carried along, but for one of the
name of the added column, which is replaced; repeated rows get the same verdict; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.llm.common import SPACE, let, word_array

# Thresholds of the rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 20
MAX_DUP_LINE_PERCENT = 60
MIN_LINES = 4
MIN_MEAN_WORD, MAX_MEAN_WORD = 2, 25
MAX_TOP_WORD_PERCENT = 40
#: Rows that the order of the rules is estimated on, one in so many by the hash of the text, and the longest text among
#: them in bytes: they travel to the driver. Longer ones have about as many steps a character, so their lack shifts no order.
SAMPLE_ROWS, SAMPLE_OF, SAMPLE_TEXT = 256, 8, 1 << 16


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def n_words(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    return let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(text: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    Windows are compared by a 64-bit hash. Sorting (hash, place) brings equal windows together; in the sorted places of
    those that repeat, each window adds three words, or fewer where the next one begins before its end.
    """

    def hashes(w: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        return F.when(F.size(w) >= 3, whole).otherwise(F.array().cast("array<bigint>"))

    def covered(at: Column) -> Column:
        ends = F.concat(at, F.array(F.element_at(at, -1) + 3))
        return let(ends, lambda e: F.aggregate(F.sequence(F.lit(0), F.size(e) - 2), F.lit(0).cast("bigint"), lambda a, j: a + F.least(F.lit(3), e[j + 1] - e[j])))

    def places(s: Column) -> Column:
        def again(x: Column, i: Column) -> Column:
            same = lambda j: F.get(s, j)["h"].eqNullSafe(x["h"])
            return F.when(same(i - 1) | same(i + 1), x["i"])

        return F.sort_array(F.filter(F.transform(s, again), lambda i: i.isNotNull()))

    def repeated(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(by_hash, places), covered))

    return let(let(word_array(text), hashes), repeated).cast("long")


def top_word(text: Column) -> Column:
    """How often the most frequent word of more than one character occurs: the longest run of equal ones among the sorted words."""

    def longest(w: Column) -> Column:
        new = lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1))
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), new)
        gaps = let(starts, lambda s: F.transform(s, lambda x, k: F.coalesce(F.get(s, k + 1), F.size(w)) - x))
        return F.when(F.size(w) > 0, F.array_max(gaps)).otherwise(F.lit(0))

    return let(F.sort_array(F.filter(word_array(text), lambda w: F.length(w) > 1)), longest).cast("long")


@dataclass(frozen=True)
class Measure:
    """What rules read: a function of the text, and the steps it takes, by the counts of `COUNTS` of a text."""

    of: Callable[[Column], Column]
    steps: Callable[[dict[str, int]], int]


#: What the steps of measures are counted by.
COUNTS: dict[str, Callable[[Column], Column]] = {
    "chars": F.length,
    "words": n_words,
    "lines": lambda t: F.size(F.split(t, "\n")),
    "solid": word_chars,
    "symbols": n_symbols,
}


def _sorting(n: int) -> int:
    return n * n.bit_length()


MEASURES: dict[str, Measure] = {
    "n_words": Measure(n_words, lambda c: c["chars"] + c["words"]),
    "word_chars": Measure(word_chars, lambda c: c["chars"] + c["solid"]),
    "n_symbols": Measure(n_symbols, lambda c: c["chars"] + c["symbols"]),
    "lines": Measure(lambda t: let(_lines(t), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))), lambda c: 2 * c["chars"] + 3 * c["lines"]),
    # Words, a hash of three of them for each window, a set, and a sort of the windows.
    "n_repeat_words": Measure(n_repeat_words, lambda c: c["chars"] + 3 * c["solid"] + 3 * c["words"] + _sorting(c["words"])),
    # Words, a filter, a sort of them, two looks at each, and the gaps.
    "top_word": Measure(top_word, lambda c: c["chars"] + 4 * c["words"] + _sorting(c["words"])),
}


@dataclass(frozen=True)
class Rule:
    """`fails` takes the measures in `needs` by name and is true where a document is rejected."""

    name: str
    needs: tuple[str, ...]
    fails: Callable[[dict[str, Column]], Column]


RULES = [
    Rule("few_words", ("n_words",), lambda m: m["n_words"] < MIN_WORDS),
    Rule("symbols", ("n_symbols", "word_chars"), lambda m: 100 * m["n_symbols"] > MAX_SYMBOL_PERCENT * m["word_chars"]),
    Rule("repeated_lines", ("lines",), lambda m: (m["lines"]["n"] >= MIN_LINES) & (100 * m["lines"]["dup"] > MAX_DUP_LINE_PERCENT * m["lines"]["n"])),
    Rule("word_length", ("n_words", "word_chars"), lambda m: (m["word_chars"] < MIN_MEAN_WORD * m["n_words"]) | (m["word_chars"] > MAX_MEAN_WORD * m["n_words"])),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda m: 100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"]),
    Rule("one_word", ("top_word", "n_words"), lambda m: 100 * m["top_word"] > MAX_TOP_WORD_PERCENT * m["n_words"]),
]
BASE_RULES = ("few_words", "repeated_words")


def sample_of(docs: DataFrame, text: str = "text") -> DataFrame | None:
    """Up to SAMPLE_ROWS texts, chosen by their hash, as a table of its own; None if there are none."""
    few = docs.select(_text(text).alias("text")).where((F.octet_length("text") <= SAMPLE_TEXT) & (F.pmod(F.xxhash64("text"), F.lit(SAMPLE_OF)) == 0))
    rows = few.limit(SAMPLE_ROWS).collect()
    return docs.sparkSession.createDataFrame(rows, "text string").coalesce(1) if rows else None


def ordered_rules(docs: DataFrame, rules: list[Rule], text: str = "text", known: tuple[str, ...] = ()) -> list[Rule]:
    """The rules by rejection per cost, one by one: what earlier rules have measured costs a later one nothing.

    One job over the sample tells which rules reject each text and its counts; a rule's cost is the steps of its measures
    not yet taken, in all texts that the rules before it leave, and its selectivity is of these texts, too. Both are
    counted, not timed, and so the same in each run over the same sample. `known` measures cost nothing at all; ties keep the order given.
    """
    sample = sample_of(docs, text)
    if sample is None:
        return list(rules)
    measures = {m: MEASURES[m].of(F.col("text")) for m in dict.fromkeys(n for r in rules for n in r.needs)}
    counts = {f"c_{c}": f(F.col("text")).cast("long") for c, f in COUNTS.items()}
    told = sample.select(*[x.alias(c) for c, x in counts.items()], *[x.alias(m) for m, x in measures.items()])
    told = told.select(*counts, *[F.coalesce(r.fails({m: F.col(m) for m in r.needs}), F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)]).collect()
    each = [{c: t[f"c_{c}"] for c in COUNTS} for t in told]
    steps = [{m: MEASURES[m].steps(c) for m in measures} for c in each]
    left, order, have, rest = list(zip(told, steps, strict=True)), [], set(known), list(range(len(rules)))
    while rest:
        # A rule takes a step of its own for each text.
        cost = {i: 1 + sum(1 + sum(s[m] for m in rules[i].needs if m not in have) for _, s in left) for i in rest}
        best = max(rest, key=lambda i: (sum(t[f"r{i}"] for t, _ in left) / cost[i], -cost[i], -i))  # noqa: B023
        order.append(rules[best])
        have |= set(rules[best].needs)
        left = [(t, s) for t, s in left if not t[f"r{best}"]]
        rest.remove(best)
    return order


def cascade(rules: list[Rule], text: Column, known: dict[str, Column] | None = None) -> Column:
    """Whether a rule rejects. A rule is evaluated for texts alone that those before it let pass, and a measure once a text."""
    have = dict(known or {})
    if not rules:
        return F.lit(False)
    rule, new = rules[0], [m for m in rules[0].needs if m not in have]

    def verdict(have: dict[str, Column]) -> Column:
        return F.coalesce(rule.fails(have), F.lit(False)) | cascade(rules[1:], text, have)

    if not new:
        return verdict(have)
    return let(F.struct(*[MEASURES[m].of(text).alias(m) for m in new]), lambda s: verdict(have | {m: s[m] for m in new}))


def quality_cascade(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", into: str = "rejected") -> DataFrame:
    """`docs` with `into`: whether a rule rejects the document. Which one did first depends on the order, so it isn't told."""
    return docs.withColumn(into, _rejected(docs, rules, text))


def _rejected(docs: DataFrame, rules: list[Rule] | None, text: str) -> Column:
    return cascade(ordered_rules(docs, RULES if rules is None else rules, text), _text(text))


def passing(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """The rows of `docs` that no rule rejects."""
    return docs.where(~_rejected(docs, rules, text))


#: The measures that the digest tells of every document.
TOLD = ("n_words", "word_chars", "n_symbols", "lines", "n_repeat_words")


def quality_digest(docs: DataFrame) -> DataFrame:
    """One row per document: its measures, whether it fails the base rules, and whether the cascade keeps it.

    The told measures are taken once for all rules; rules that need others are evaluated for documents alone that pass
    the rest.
    """
    measured = docs.select("doc_id", _text("text").alias("text")).withColumns({m: MEASURES[m].of(F.col("text")) for m in TOLD})
    told = {m: F.col(m) for m in TOLD}
    failed = F.lit(False)
    for r in RULES:
        if r.name in BASE_RULES:
            failed = failed | r.fails(told)
    rejected = cascade(ordered_rules(docs, RULES, known=TOLD), F.col("text"), told)
    return measured.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        F.col("lines.dup").alias("n_dup_lines"),
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~rejected).alias("kept"),
    )
