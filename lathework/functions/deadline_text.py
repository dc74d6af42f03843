"""Deadlines that stand in free text.

One pass over a text finds four kinds of tokens: phrases that open a period, section marks, range marks, and dates. A
small fold over the tokens after a phrase then decides; the first phrase with a date in its reach counts.
"""

from __future__ import annotations

import datetime as dt
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

# The phrases, marks and spellings of dates in notices. A phrase before a word of mere reference opens nothing.
TOKEN = re.compile(
    r"""
    (?P<opener> (?> (?:접수|신청|공모|모집|제출|등록) \s* (?:기간|기한|마감\s*(?:일시|일자|일|기한|시한)|마감) | 마감\s*(?:일시|일자|일|기한|시한) )
        (?! \s* (?: 기준|현재|전일|전날|전까지|이전|이후|으로부터|로부터|부터|임박|연장|까지|동안 | (?:내|중)(?=\Z|[\s에,.)]) ) ) )
    | (?P<section> [□■▣◆◇] )
    | (?P<date>
        (?: (?<!\d) 20\d\d | [’'‘`´] \d\d ) \s* [.\-/년] \s* \d\d? \s* [.\-/월] \s* \d\d? (?!\d)
        | (?<=[~～∼〜]) \s* \d\d? \s* \. \s* \d\d? (?![\d:])
        | (?<![\d.]) \d\d? \s* 월 \s* \d\d? \s* 일
        | (?<![\d.]) \d\d? \s* \. \s* \d\d? \s* \.? \s* (?=\(\s*[월화수목금토일]) )
        (?: (?= \s* \.? \s* \( \s* (?P<weekday>[월화수목금토일]) ) | )
    | (?P<wave> [~～∼〜] ) | (?P<dash> [–—] | \s-\s ) | (?P<since> 부터 )
    """,
    re.VERBOSE,
)
WEEKDAYS, WAVES = "월화수목금토일", ("~", "～", "∼", "〜")
#: Characters after a phrase in which its dates stand, and after a date in which a mark makes it the begin of a period.
REACH, OPEN_REACH = 160, 25


def _dated(token: re.Match, before: dt.date | None, ref: dt.date) -> dt.date | None:
    """The day a date token tells. A year left out is the one that fits the weekday, else the first not too early."""
    *year, month, day = map(int, re.findall(r"\d+", token["date"]))
    base = year[0] % 100 + 2000 if year else (before or ref).year
    possible = []
    for y in (base,) if year else (base, base + 1, base - 1):
        try:
            possible.append(dt.date(y, month, day))
        except ValueError:  # no such day in that year
            continue
    fitting = [d for d in possible if not year and WEEKDAYS[d.weekday()] == token["weekday"]]
    ahead = [d for d in possible if d.year >= base]
    floor = before or ref - dt.timedelta(days=183)
    in_time = [d for d in ahead if year or d >= floor]
    return next(iter(fitting + in_time + ahead), None)


def _told(tokens: list[re.Match], begin: int, ref: dt.date) -> tuple[bool, dt.date | None]:
    """Whether there is a date among the tokens after a phrase that ends at `begin`, and the deadline they tell."""
    first: re.Match | None = None
    last, first_day, ranged, opened = None, None, False, False
    for t in tokens:
        if t["section"] or t.end() > begin + REACH:
            break
        if t["date"]:
            day = _dated(t, last, ref)
            if day is None:
                continue
            before = t.string[begin : t.start()].rstrip()
            if ranged if first else before.endswith(WAVES):
                return True, day
            first, first_day = first or t, first_day or day
            last, ranged = day, False
        elif t["wave"] or t["dash"] or t["since"]:
            ranged = True
            opened |= first is not None and not t["dash"] and t.start() - first.end() <= OPEN_REACH
    return first is not None, None if opened else first_day


def deadline_in(text: str | None, ref: dt.date) -> dt.datetime | None:
    """The last second of the day of the deadline; null if there is none or the period has no end."""
    tokens = list(TOKEN.finditer(re.sub(r"\s+", " ", text or "")))
    for k, t in enumerate(tokens):
        if t["opener"]:
            found, day = _told(tokens[k + 1 :], t.end(), ref)
            if found:
                return day and dt.datetime.combine(day, dt.time(23, 59, 59))
    return None


@F.pandas_udf(TimestampNTZType())
def deadline_from_text(texts: pd.Series, refs: pd.Series) -> pd.Series:
    """The deadline told in each text; `refs` are the days that dates without a year are read on."""
    return pd.Series([deadline_in(t, pd.Timestamp(r).date()) for t, r in zip(texts, refs, strict=True)], dtype="datetime64[us]")
