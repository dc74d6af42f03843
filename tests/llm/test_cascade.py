"""The order of the quality rules: by rejection per step, counted on a sample; it saves steps and leaves verdicts alone."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lathework.llm import quality


def texts():
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(3, 8)))
    good = [" ".join(word() for _ in range(r.randint(60, 300))) for _ in range(150)]
    bad = [" ".join(word() + "#$%&" for _ in range(r.randint(60, 300))) for _ in range(300)]
    short = [" ".join(word() for _ in range(r.randint(1, 40))) for _ in range(30)]
    again = [" ".join(["one two three"] * 40) for _ in range(10)]
    return [*good, *bad, *short, *again, "", None]


def steps(rows, rules):
    """Steps that a cascade of `rules` takes over rows of counts and verdicts."""
    total = 0
    for r in rows:
        have = set()
        for rule in rules:
            total += sum(quality.MEASURES[m].steps(r) for m in rule.needs if m not in have)
            have |= set(rule.needs)
            if r[rule.name]:
                break
    return total


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(texts())), "doc_id bigint, text string").cache()


def told(docs):
    t = F.coalesce(F.col("text"), F.lit(""))
    measures = docs.select("doc_id", *[f(t).cast("long").alias(c) for c, f in quality.COUNTS.items()], *[m.of(t).alias(f"m_{k}") for k, m in quality.MEASURES.items()])
    failed = [F.coalesce(r.fails({m: F.col(f"m_{m}") for m in r.needs}), F.lit(False)).alias(r.name) for r in quality.RULES]
    return [r.asDict() for r in measures.select("doc_id", *quality.COUNTS, *failed).collect()]


def test_order_saves_steps(docs):
    rows, rules = told(docs), quality.RULES
    order = quality.ordered_rules(docs, rules)
    assert sorted(r.name for r in order) == sorted(r.name for r in rules)
    # Most texts fail by symbols, which are cheap; the dear rules come last.
    assert order[0].name == "symbols"
    assert {r.name for r in order[-2:]} <= {"repeated_words", "one_word", "repeated_lines"}
    own, listed, backwards = steps(rows, order), steps(rows, rules), steps(rows, order[::-1])
    every = sum(m.steps(r) for r in rows for m in quality.MEASURES.values())
    assert own < listed < every and own < backwards


def test_order_leaves_verdicts(docs):
    want = sorted(r["doc_id"] for r in told(docs) if not any(r[x.name] for x in quality.RULES))
    for rules in (None, quality.RULES[::-1]):
        assert sorted(r.doc_id for r in quality.passing(docs, rules).collect()) == want
    assert {r.name for r in quality.ordered_rules(docs, quality.RULES)} == {r.name for r in quality.ordered_rules(docs, quality.RULES[::-1])}


def test_no_sample(docs):
    assert quality.ordered_rules(docs.limit(0), quality.RULES) == quality.RULES
