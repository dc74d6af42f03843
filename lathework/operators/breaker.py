"""Circuits as ordered state: a source that fails too often in a row is left alone for a while, then tried again.

What a circuit does with a call depends on all calls before it, but through one of few states only: so many failures in a
row, so many calls skipped, or on trial. Calls are sorted by source and order and cut into segments of one length. A source
within a segment begins closed. For one that goes on into another, its calls in a segment make a function from states to
states; these are made for all segments at once and composed along the source, and each segment is then run from the state
it begins in. A source may so have any number of calls: a task holds a segment, or one source's functions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.operators.ranking import quota
from lathework.operators.sequence import numbered

#: Calls of a segment.
SEGMENT = 1 << 14


def _machine(limit: int, pause: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(next, called): the state after a call that would fare well or fail, and whether it is made, for each state.

    States below `limit` are closed, after as many failures in a row; then come `pause` states in which a call is skipped,
    and the last, in which one is made on trial. Without a pause an open circuit stays so.
    """
    if limit < 1 or (pause is not None and pause < 1):
        raise ValueError("limit and pause have to be at least 1")
    skipping = 1 if pause is None else pause
    last = limit + skipping
    n = last + (pause is not None)
    after, called = np.zeros((n, 2), np.int64), np.ones(n, bool)
    after[:limit, 1] = np.arange(1, limit + 1)
    for s in range(limit, last):
        after[s], called[s] = s + (pause is not None), False
    if pause is not None:
        after[last] = 0, limit
    return after, called


def with_states(calls: DataFrame, source: str, order: list[Column], failed: Column, limit: int = 3, pause: int | None = None, segment: int | None = None) -> DataFrame:
    """`calls` with `outcome`: ok, failed, or skipped while the circuit of their source is open.

    A circuit opens after `limit` failures in a row, skips `pause` calls, makes one, and closes if that goes well, or else
    skips as many again; without a pause it never closes. `failed` says how a call fares if it is made; null is a
    failure. `order` has to tell the calls of a source apart. Calls without a source are those of one source. An empty
    table gives an empty table.
    """
    after, called = _machine(limit, pause)
    size = segment or SEGMENT
    n = len(after)
    placed = numbered(calls.withColumn("_failed", F.coalesce(failed, F.lit(True))), [F.col(source), *order], "_number")
    bits = placed.select(F.floor(F.col("_number") / size).cast("bigint").alias("segment"), F.col("_number").alias("number"), F.col(source).alias("source"), "_failed")
    kind = calls.schema[source].dataType.simpleString()
    steps = after.tolist()

    def runs(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        """Rows in order, and where sources begin and end."""
        rows = rows.sort_values("number")
        codes = pd.factorize(rows["source"])[0]
        return rows, np.concatenate(([0], np.flatnonzero(np.diff(codes)) + 1, [len(rows)]))

    def functions(rows: pd.DataFrame) -> pd.DataFrame:
        rows, cuts = runs(rows)
        bad = rows["_failed"].to_numpy(bool).astype(np.int64)
        found = []
        for i in sorted({0, len(cuts) - 2}):  # the others do not leave the segment
            ends = np.arange(n)
            for x in bad[cuts[i] : cuts[i + 1]]:
                ends = after[ends, x]
            found.append(ends.tolist())
        at = [0] if len(cuts) == 2 else [0, cuts[-2]]
        return pd.DataFrame({"source": rows["source"].iloc[at], "segment": rows["segment"].iloc[at], "leads": [i == 0 for i in at], "ends": found})

    def composed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("segment")
        state, begins = 0, []
        for ends in rows["ends"]:
            begins.append(state)
            state = int(ends[state])
        return pd.DataFrame({"segment": rows["segment"], "leads": rows["leads"], "begin": begins})

    def outcomes(rows: pd.DataFrame) -> pd.DataFrame:
        rows, cuts = runs(rows)
        bad, fresh = rows["_failed"].to_numpy(bool).tolist(), set(cuts[1:].tolist())
        state, found = int(rows["begin"].iloc[0]), []
        for i, x in enumerate(bad):
            state = 0 if i in fresh else state
            found.append("skipped" if not called[state] else "failed" if x else "ok")
            state = steps[state][x]
        return pd.DataFrame({"number": rows["number"], "outcome": found})

    made = bits.groupBy("segment").applyInPandas(functions, f"source {kind}, segment bigint, leads boolean, ends array<bigint>")
    begins = made.groupBy("source").applyInPandas(composed, "segment bigint, leads boolean, begin bigint").where("leads").drop("leads")
    states = bits.join(begins, "segment").groupBy("segment").applyInPandas(outcomes, "number bigint, outcome string")
    return placed.join(states, placed["_number"] == states["number"]).select(*calls.columns, "outcome")


def health(states: DataFrame, by: list[str], raw: Column, stale: Column, least: int = 10, share: float = 0.7) -> DataFrame:
    """A row for each of `by`: total, failed (skipped ones too), skipped, complete, all_failed, and `canaries`.

    A canary is a call that was made and went well, gave `least` rows or more, and of these more than `share` older than
    what was asked for.
    """
    made = F.col("outcome") == "ok"
    return states.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(~made).alias("failed"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.every(made).alias("complete"),
        F.every(~made).alias("all_failed"),
        F.count_if(made & (raw >= least) & (stale > raw * share)).alias("canaries"),
    )


def unavailable(judged: DataFrame, by: list[str], order: list[Column], failed: Column, first: int = 3, share: float = 0.5) -> DataFrame:
    """(by..., attempted, failed, unavailable): a judge is, if its first calls all fail, or `first` and at least the share of all.

    Spark keeps only `first` calls of a group in each task before it shuffles them, so a large group is no single task's.
    """
    bad = F.coalesce(failed, F.lit(True))
    rows = judged.select(*by, bad.alias("_bad"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], bad.alias("bad")).alias("_call"))
    counted = rows.groupBy(*by).agg(F.count("*").alias("attempted"), F.count_if("_bad").alias("failed"))
    heads = quota(rows, by, [F.col("_call")], first).groupBy(*by).agg(F.count_if("_bad").alias("_head"))
    heads = heads.select(*[F.col(c).alias(f"_{c}") for c in by], "_head")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    opened = (F.col("_head") >= first) | ((F.col("failed") >= first) & (F.col("failed") >= share * F.col("attempted")))
    return counted.join(heads, same).select(*by, "attempted", "failed", opened.alias("unavailable"))
