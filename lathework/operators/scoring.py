"""Scores by a judge that takes rows in batches, drops some, repeats others and fails at times.

Rows are numbered in an order of theirs and dealt into batches of `size`; each batch is one group of a task and one call.
What a batch has no valid answer for is found, dealt into batches anew and asked once more. Rows of a call that failed, in
both rounds, get the fallback's score, if there is one; rows that a judge has merely passed over stay unjudged, so that no
cache takes them for rejected.

Answers are stored once given, so a lost executor or a second use of the result does not change them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.operators.lineage import cut
from lathework.operators.sequence import numbered

#: Takes a batch with its rows' numbers as `no`, from 0, and returns (no, score) rows.
Judge = Callable[[pd.DataFrame], pd.DataFrame]


def valid_answers(answers: pd.DataFrame, size: int) -> dict[int, float]:
    """The first valid score for each number of a batch, within 0 and 1; truth values, NaN and what is no number are none."""
    out: dict[int, float] = {}
    for no, score in zip(answers["no"].tolist(), answers["score"].tolist(), strict=True):
        good = not isinstance(score, bool) and isinstance(score, (int, float)) and not math.isnan(score)
        if good and isinstance(no, (int, float)) and not isinstance(no, bool) and no in range(size) and int(no) not in out:
            out[int(no)] = min(1.0, max(0.0, float(score)))
    return out


def _asked(rows: DataFrame, key: str, order: list[Column], judge: Judge, size: int) -> DataFrame:
    """(key, score, note) of the rows that have an answer, or whose call failed."""
    kind = rows.schema[key].dataType.simpleString()

    def call(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("no").reset_index(drop=True)
        try:
            found = valid_answers(judge(batch.drop(columns="_batch")), len(batch))
        except Exception as e:  # whatever a judge does wrong, other batches go on
            note = f"{type(e).__name__}: {e}"[:200]
            return pd.DataFrame({key: batch[key], "score": [None] * len(batch), "note": [note] * len(batch)})
        rows = batch[[key]].iloc[list(found)]
        return rows.assign(score=list(found.values()), note=pd.Series(None, rows.index, object))  # a list of no notes would count as numbers

    placed = numbered(rows, order, "_number")
    placed = placed.withColumns({"_batch": F.floor(F.col("_number") / size), "no": (F.col("_number") % size).cast("int")}).drop("_number")
    return cut(placed.groupBy("_batch").applyInPandas(call, f"{key} {kind}, score double, note string"))


def judged(rows: DataFrame, key: str, order: list[Column], judge: Judge, size: int = 60, fallback: Column | None = None) -> DataFrame:
    """`rows` with `score`, `judged` (first, retry, fallback; null for unjudged) and `note`, the last failure if there was one.

    `key` and `order` have to be unique; the judge sees all columns of `rows` but those of the result's names.
    """
    rows = rows.drop("score", "judged", "note")
    first = _asked(rows, key, order, judge, size)
    missing = rows.join(first.where("score is not null"), key, "left_anti")
    again = _asked(missing, key, order, judge, size)
    a = first.select(key, F.col("score").alias("_a"), F.col("note").alias("_an"))
    b = again.select(key, F.col("score").alias("_b"), F.col("note").alias("_bn"))
    met = rows.join(a, key, "left").join(b, key, "left")
    failed = F.col("_an").isNotNull() & F.col("_bn").isNotNull()
    spare = F.when(failed, fallback.cast("double")) if fallback is not None else F.lit(None).cast("double")
    how = F.when(F.col("_a").isNotNull(), "first").when(F.col("_b").isNotNull(), "retry").when(spare.isNotNull(), "fallback")
    return met.select(*rows.columns, F.coalesce("_a", "_b", spare).alias("score"), how.alias("judged"), F.when(F.col("_a").isNull(), F.coalesce("_bn", "_an")).alias("note"))


def scorer(judge: Judge, key: str, order: list[Column], size: int = 60, fallback: Column | None = None) -> Callable[[DataFrame], DataFrame]:
    """`judged` as a step of a plan that takes rows and gives them with a score, such as `plans.announcements.monitor`."""
    return lambda rows: judged(rows, key, order, judge, size, fallback)
