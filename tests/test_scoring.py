"""Batched scores with a retry, against a plain loop over the same stub of a judge."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lathework.operators import scoring


def stub(batch: pd.DataFrame) -> pd.DataFrame:
    """Passes over some rows unless few are asked, repeats and invents numbers, and fails on batches with a bad row."""
    if (batch["id"] % 50 == 49).any():
        raise ValueError("overloaded")
    out = []
    for no, i in zip(batch["no"], batch["id"], strict=True):
        if i % 7 == 3 and (len(batch) == 10 and no > 2 or i % 2):
            continue
        out += [(no, (i % 13) / 10), (no, 0.99)] if i % 5 else [(no, float("nan")), (no, i / 100)]
    out += [(len(batch), 0.5), (-1, 0.5), (0, 0.77)]
    return pd.DataFrame(out, columns=["no", "score"])


def plain(ids, size, fallback):
    def ask(left):
        scores, failed = {}, set()
        for k in range(0, len(left), size):
            batch = left[k : k + size]
            try:
                answers = stub(pd.DataFrame({"id": batch, "no": range(len(batch))}))
            except ValueError:
                failed |= set(batch)
                continue
            for no, score in answers.itertuples(index=False):
                if 0 <= no < len(batch) and score == score and batch[int(no)] not in scores:
                    scores[batch[int(no)]] = min(1.0, max(0.0, score))
        return scores, failed

    first, failed = ask(ids)
    second, again = ask([i for i in ids if i not in first])
    return {i: (first[i], "first") if i in first else (second[i], "retry") if i in second else (fallback(i), "fallback") if i in failed & again else (None, None) for i in ids}


def test_against_a_loop(spark):
    ids = list(range(173))
    rows = spark.createDataFrame([(i, f"t{i}", "own") for i in reversed(ids)], "id bigint, title string, note string").repartition(5)
    got = scoring.judged(rows, "id", [F.col("id")], stub, 10, F.when(F.col("id") % 2 == 0, 0.25).otherwise(0.5)).collect()
    want = plain(ids, 10, lambda i: 0.25 if i % 2 == 0 else 0.5)
    assert {r.id: (r.score, r.judged) for r in got} == want
    assert {"first", "retry", "fallback", None} == {j for _, j in want.values()}
    assert all(r.note == "ValueError: overloaded" for r in got if r.judged == "fallback")
    bare = scoring.judged(rows, "id", [F.col("id")], stub, 10).where("judged = 'fallback'")
    assert bare.count() == 0
    assert scoring.judged(rows.limit(0), "id", [F.col("id")], stub).collect() == []


def test_answers():
    answers = pd.DataFrame({"no": [0, 0, 1, 2, 3, None, True], "score": [True, 0.4, "x", 3, -1, 0.5, 0.5]}, dtype=object)
    assert scoring.valid_answers(answers, 4) == {0: 0.4, 2: 1.0, 3: 0.0}
