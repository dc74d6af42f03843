"""Search texts for news: from terms to what is asked, and to what a reader sees of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTED = r'"[^"]*"'
_INNER = rf'\((?:{_QUOTED}|[^"()])*\)'
#: A term, a quoted text or a bracket (with brackets in it), or several of these without a blank between.
_UNIT = rf'(?:{_QUOTED}|\((?:{_QUOTED}|{_INNER}|[^"()])*\)|[^ "()])+'
#: How terms of a group, groups and what is left out are told.
EITHER, BOTH, WITHOUT = " · ", " × ", "  (제외: {})"
#: The longest text that a search takes.
LONGEST = 190


def _term(unit: Column) -> Column:
    """A term without its field and quotation marks."""
    return F.regexp_replace(F.regexp_replace(F.trim(unit), "^intitle:", ""), '(?s)^"(.*)"$', "$1")


def readable_search(search: Column) -> Column:
    """What a search asks for, as a reader sees it: terms of a group, groups that all have to hold, terms left out.

    The time limit is not told. Brackets may hold brackets once; a quotation mark or bracket without its other is dropped.
    A null search reads as empty.
    """
    units = F.regexp_extract_all(F.regexp_replace(F.coalesce(search, F.lit("")), r"\bwhen:[0-9]+d\b", ""), F.lit(_UNIT), F.lit(0))
    out = F.transform(F.filter(units, lambda u: u.startswith("-")), lambda u: _term(F.regexp_replace(u, "^-", "")))
    inner = lambda u: F.regexp_replace(u, r"(?s)^\((.*)\)$", "$1")
    terms = lambda u: F.filter(F.regexp_extract_all(inner(u), F.lit(_UNIT), F.lit(0)), lambda t: t != "OR")
    groups = F.transform(F.filter(units, lambda u: ~u.startswith("-")), lambda u: F.array_join(F.transform(terms(u), _term), EITHER))
    before, after = WITHOUT.split("{}")
    told = F.when(F.size(out) > 0, F.concat(F.lit(before), F.array_join(out, ", "), F.lit(after))).otherwise("")
    return F.concat(F.array_join(F.filter(groups, lambda g: g != ""), BOTH), told)


def open_search(terms: Column, days: Column, most: int = LONGEST) -> Column:
    """The search for terms in all outlets within so many days; one that is too long is an error, as it would be cut."""
    search = F.concat(terms, F.lit(" when:"), days.cast("string"), F.lit("d"))
    return F.when(F.length(search) > most, F.raise_error(F.concat(F.lit("search too long: "), search))).otherwise(search)
