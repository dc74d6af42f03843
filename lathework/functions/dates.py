"""Expressions over dates. Every one takes the day it is asked on (`as_of`); none reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_until(deadline: Column, as_of: Column) -> Column:
    """Whole days from `as_of` to `deadline`; negative once it has passed."""
    return F.datediff(deadline.cast("date"), as_of.cast("date"))


def d_day(deadline: Column, as_of: Column) -> Column:
    """Days left, null when the deadline is unknown or has passed."""
    n = days_until(deadline, as_of)
    return F.when(n >= 0, n)


def d_day_label(deadline: Column, as_of: Column) -> Column:
    n = days_until(deadline, as_of)
    return F.when(n.isNull(), "unknown").when(n < 0, "closed").when(n == 0, "D-Day").otherwise(F.concat(F.lit("D-"), n.cast("string")))


def first_date(text: Column, formats: list[str]) -> Column:
    """The date by the first format that fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats])


def lookback_days(base: Column, last_success: Column, now: Column, most: int = 7) -> Column:
    """Days to look back: `base`, more after a gap since the last success, from 1 to `most`."""
    gap = F.ceil((F.unix_timestamp(now) - F.unix_timestamp(last_success)) / 86400.0) + 1
    return F.greatest(F.lit(1), F.least(F.lit(most), F.greatest(base, F.coalesce(gap, F.lit(most))))).cast("int")


def expiry(at: Column, key: Column, days: int = 14, jitter: int = 7) -> Column:
    """When a cached verdict expires: `days` later, spread by a checksum of the key so that not all expire together."""
    return F.date_add(at.cast("date"), (F.lit(days) + F.crc32(key.cast("string")) % jitter).cast("int"))


# How sources write days.
DAY_FORMATS = ["yyyy-M-d", "yyyy.M.d", "yyyy/M/d", "yyyyMMdd", "yyyy-M-d HH:mm:ss", "yyyy-M-d HH:mm", "yyyy.M.d HH:mm", "yyyy-M-d'T'HH:mm:ss"]
ENGLISH_FORMATS = ["MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z"]
WEEKDAYS = "일월화수목금토"


def end_of_day(day: Column) -> Column:
    """The last second of a day, without a zone: when a deadline given as a day ends."""
    return (day.cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 SECOND")).cast("timestamp_ntz")


def source_date(text: Column) -> Column:
    """A day as sources write it; a closing dot and blanks after dots don't matter."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"\.\s+", "."), r"\.$", "")
    return first_date(plain, DAY_FORMATS)


def english_date(text: Column) -> Column:
    return first_date(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), ENGLISH_FORMATS)


def d_day_from_label(label: Column) -> Column:
    """Days left by a label: D-13 is 13, D-day and today's word are 0, others are null."""
    plain = F.lower(F.trim(label))
    n = F.regexp_extract(plain, r"^d\s*-\s*(\d+)", 1)
    return F.when(n != "", n.try_cast("int")).when(plain.rlike(r"^(d\s*-\s*day|오늘.*)$"), 0)


def due_label(due: Column, as_of: Column) -> Column:
    """How a task's day stands to `as_of`: none, today, over by n days, or the day."""
    late = F.datediff(as_of, due)
    return F.when(due.isNull(), "none").when(late == 0, "today").when(late > 0, F.concat(F.date_format(due, "yyyy-MM-dd"), F.lit(" over by "), late.cast("string"))).otherwise(F.date_format(due, "yyyy-MM-dd"))


def day_with_weekday(at: Column, zone: str = "Asia/Seoul") -> Column:
    """Month/day and weekday of an instant in a zone."""
    local = F.from_utc_timestamp(at, zone)
    return F.concat(F.date_format(local, "M/d"), F.lit("("), F.substring(F.lit(WEEKDAYS), F.dayofweek(local), F.lit(1)), F.lit(")"))


def watermark(last: Column, now: Column, usual_hours: int = 24, most_hours: int = 72) -> Column:
    """From when to read: the last run, the usual span without one or with one in the future, at most `most_hours` back."""
    back = lambda h: now - F.make_interval(hours=F.lit(h))
    return F.when(last.isNull() | (last > now), back(usual_hours)).otherwise(F.greatest(last, back(most_hours)))


def cache_expiry(at: Column, key: Column, deadline: Column, most_days: int = 60) -> Column:
    """When a verdict leaves the cache: with its deadline if that is known, at most `most_days` on, else spread by key."""
    day = at.cast("date")
    return F.when(deadline.isNotNull(), F.least(deadline.cast("date"), F.date_add(day, most_days))).otherwise(expiry(at, key))


def english_time(text: Column) -> Column:
    """An instant as feeds write it."""
    plain = F.regexp_replace(F.trim(text), r"^\w{3},\s*|\s*\b(?:GMT|UTC|Z)$", "")
    zoned = [F.try_to_timestamp(plain, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss")]
    return F.coalesce(*zoned, F.trim(text).try_cast("timestamp"))
