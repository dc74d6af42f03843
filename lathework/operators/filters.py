"""Row filters and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deadline_verdict(deadline: Column, posted: Column, as_of: Column, days: int = 61) -> Column:
    """Why a row is out of the deadline window: past, too_far, old_posted; null if it stays.

    A row without a deadline stays unless it was posted more than `days` days before.
    """
    day = deadline.cast("date")
    return (
        F.when(day < as_of, "past")
        .when(day > F.date_add(as_of, days), "too_far")
        .when(day.isNull() & (posted.cast("date") < F.date_add(as_of, -days)), "old_posted")
    )


def deadline_window(rows: DataFrame, deadline: str, posted: str, as_of: Column, days: int = 61) -> DataFrame:
    return rows.where(deadline_verdict(F.col(deadline), F.col(posted), as_of, days).isNull())


def first_match(chain: list[tuple[str, Column]]) -> Column:
    """The name of the first condition that holds; null conditions don't."""
    out = None
    for name, holds in chain:
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out


def reason_counts(rows: DataFrame, reason: Column, order: list[str]) -> DataFrame:
    """(position, reason, n) for each reason in its fixed order, zeros shown."""
    spark = rows.sparkSession
    listed = spark.createDataFrame(list(enumerate(order)), "position int, reason string")
    counts = rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
    return F.broadcast(listed).join(counts, "reason", "left").select("position", "reason", F.coalesce("n", F.lit(0)).alias("n"))


def host_is_under(host: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or lies below one."""
    tests = [(host == d) | F.endswith(host, F.lit(f".{d}")) for d in domains]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out
