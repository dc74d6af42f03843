"""Projections of records: sentinels, fallbacks, lookups by name, labels by path, and texts about periods and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_sentinel(value: Column, none: object) -> Column:
    """A value for a store without nulls."""
    return F.coalesce(value, F.lit(none))


def without_sentinel(value: Column, none: object) -> Column:
    """The value again; what stands for null becomes null."""
    return F.nullif(value, F.lit(none))


def text_to_embed(title: Column, *summaries: Column) -> Column:
    """The title and the first summary that says something, on lines of their own."""
    said = F.coalesce(*[F.when(F.trim(s) != "", s) for s in summaries], F.lit(None).cast("string"))
    return F.concat_ws("\n", title, said)


def looked_up(key: Column, names: dict[str, str], otherwise: Column | None = None) -> Column:
    """What a key stands for in a fixed map; `otherwise`, by default the key itself, where it has none."""
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), key if otherwise is None else otherwise)


def first_filled(*values: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.when(v != "", v) for v in values])


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def not_an_article(url: Column, prefixes: list[str], segments: list[str]) -> Column:
    """Whether an address leads to a list, a tag or an account: by how its path begins, or by a segment in it."""
    path = F.lower(path_of(url))
    begins = F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(path, p))
    return begins | F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, segments)))


def labelled_by_path(name: Column, url: Column, labels: dict[str, str]) -> Column:
    """An outlet's name with a remark, where the path has one of the marks; the first mark counts."""
    remark = F.coalesce(*[F.when(F.contains(path_of(url), F.lit(mark)), F.lit(label)) for mark, label in labels.items()])
    return F.when(remark.isNull(), name).otherwise(F.concat(name, F.lit(" ("), remark, F.lit(")")))


def takes_kind(kind: Column, region: Column, query_kind: Column, query_region: Column) -> Column:
    """Whether an outlet answers a kind of query: its region has to be the query's, and a specialist takes its own kind alone."""
    return (region == query_region) & ((kind == "general") | (kind == query_kind))


def calendar_event(title: Column, start: Column, end: Column, all_day: Column) -> Column:
    """An event with what it lacks filled in: a name, an end an hour on or a day on, and a flag."""
    whole = F.coalesce(all_day, F.lit(False))
    usual = F.when(whole, start + F.expr("INTERVAL 1 DAY")).otherwise(start + F.expr("INTERVAL 1 HOUR"))
    return F.struct(F.coalesce(F.when(F.trim(title) != "", title), F.lit("(no title)")).alias("title"), start.alias("start"), F.coalesce(end, usual).alias("end"), whole.alias("all_day"))


def overlaps(start: Column, end: Column, time_min: Column, time_max: Column) -> Column:
    """Whether an event has any part within a time range that is open on the right."""
    return (start < time_max) & (end > time_min)


def period_text(begin: Column, end: Column) -> Column:
    """A period as text; a missing end stays open, and nothing is made up for it."""
    day = lambda d: F.date_format(d, "yyyy-MM-dd")
    return F.when(begin.isNull() & end.isNull(), "").when(end.isNull(), F.concat(day(begin), F.lit(" ~"))).when(begin.isNull(), F.concat(F.lit("~ "), day(end))).otherwise(F.concat(day(begin), F.lit(" ~ "), day(end)))


def looked_back_text(home_days: Column, other_days: Column) -> Column:
    """How far back a digest looks: one number, or two where home and other regions differ."""
    days = lambda n: F.concat(n.cast("string"), F.when(n == 1, " day").otherwise(" days"))
    return F.when(home_days == other_days, days(home_days)).otherwise(F.concat(F.lit("home "), days(home_days), F.lit(", others "), days(other_days)))


def mail_subject(day: Column, new: Column, reminders: Column) -> Column:
    """The subject of a report by mail with its counts; parts without any are left out."""
    parts = F.array_compact(F.array(F.when(new > 0, F.concat(F.lit("new "), new.cast("string"))), F.when(reminders > 0, F.concat(F.lit("due "), reminders.cast("string")))))
    return F.concat(F.lit("["), F.date_format(day, "M/d"), F.lit("] "), F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("nothing new"))


def post_time(start: Column, hour: int, minute: int) -> Column:
    """When a run's message goes out: that time of the run's day, or at once if it is past."""
    at = F.date_trunc("day", start) + F.make_dt_interval(hours=F.lit(hour), mins=F.lit(minute))
    return F.greatest(at, start)
