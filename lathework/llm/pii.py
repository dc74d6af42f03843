r"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

All of it is built of SQL functions. For one kind the matches are `regexp_extract_all` and the text between them is
`split` by the same pattern, so the running sum of both lengths gives each match's place in code points.

The patterns are possessive and anchored at the start of a run, which finds the same matches as the plain form
(`[A-Za-z0-9._%+-]+@...`) in time linear in the text, however long a run of letters or digits is.

Defined cases: null or empty text has no spans; other columns are carried along untouched, but for
one of the name of the added column, which is replaced; repeated rows are each scanned alone; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.llm.common import cut_out, free_name, in_pieces, let, running

# The kinds in output order, and their patterns. The first four are the base.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "number")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})",
    "number": r"(?<![A-Za-z0-9.+@-])[0-9]++(?:-[0-9]++){0,3}+(?![A-Za-z0-9.@-])",
}
# The length of account codes by country. Of `iban` the pattern above is the beginning alone; a code ends where
# the first of its forms that ends at a boundary passes the checksum: of its country's length, without blanks, in groups of
# four, or as far as capitals and digits go.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_HEAD, _END = "^[A-Z]{2}[0-9]{2}", "(?![A-Za-z0-9])"
CODE_FORMS = (
    _HEAD + r"[A-Z0-9]{11,30}+" + _END,
    _HEAD + rf"(?:\x20[A-Z0-9]{{4}}{_END}){{2,7}}+(?:\x20[A-Z0-9]{{1,3}}{_END})?+",
    _HEAD + r"(?:\x20?[A-Z0-9]){11,30}+" + _END,
)
#: Code points that hold any code with its blanks and the character behind it.
CODE_WIDTH = 65
# The score of a confirmed match, and what a nearby word of its kind adds.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "number": 0.3}
CONTEXT_SCORE = 0.4
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write)\b",
    "ip": r"(?i)\b(?:ip|host|server|address)\b",
    "card": r"(?i)\b(?:card|credit|debit|visa|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax)\b",
    "iban": r"(?i)\b(?:iban|bank|account|konto|cuenta|compte)\b",
    "number": r"(?i)\b(?:ssn|social security|passport|account|licen[cs]e|phone|tel|mobile)\b",
}
#: Code points before a match in which a context word counts.
CONTEXT_WIDTH = 40
#: A match that is not of the base needs this score.
THRESHOLD = 0.6

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: let(c.cast("int") * (1 + i % 2), lambda d: d - F.when(d > 9, 9).otherwise(0)),
    )
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code without blanks leaves 1 when divided by 97, its first four characters moved to the end."""
    moved = F.concat(F.substring(code, 5, 1_000), F.substring(code, 1, 4))
    rest = F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "number":
        return F.length(_digits(m)).between(7, 12)
    return F.lit(True)


def _account_code(window: Column) -> Column:
    """The account code that a window of text begins with; null if none passes the checksum."""
    country = F.substring(window, 1, 2)
    size = F.lit(None).cast("int")
    for n, countries in LENGTHS.items():
        size = F.when(country.isin(*countries.split()), n - 4).otherwise(size)
    own = F.concat(F.lit(rf"{_HEAD}(?:\x20?[A-Z0-9]){{"), size.cast("string"), F.lit(f"}}{_END}"))
    forms = F.array(F.regexp_substr(window, own), *[F.regexp_substr(window, F.lit(p)) for p in CODE_FORMS])
    passes = lambda m: let(F.replace(m, F.lit(" "), F.lit("")), lambda c: F.length(c).between(15, 34) & mod97(c))
    return F.try_element_at(F.filter(F.array_compact(forms), passes), F.lit(1))


def _apart(spans: Column) -> Column:
    """Spans in order without those that begin within one before."""

    def step(kept: Column, s: Column) -> Column:
        within = F.coalesce(F.try_element_at(kept, F.lit(-1))["end"] > s["start"], F.lit(False))
        return F.when(within, kept).otherwise(F.concat(kept, F.array(s)))

    def apart(s: Column) -> Column:
        overlap = F.exists(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: F.coalesce(F.get(s, i)["start"] < F.get(s, i - 1)["end"], F.lit(False)))
        return F.when(~overlap, s).otherwise(F.aggregate(s, F.array().cast(f"array<{SPAN}>"), step))

    return let(spans, apart)


SPAN = "struct<kind string, start int, end int, score double>"


def _spans(kind: str, text: Column, pieces: Column) -> Column:
    """Confirmed matches of one kind with their places and scores; `pieces` is the text in pieces."""
    pattern = F.lit(PATTERNS[kind])

    def placed(found: Column) -> Column:
        def starts(gaps: Column) -> Column:
            both = F.transform(found, lambda m, i: F.length(gaps[i]) + F.length(m))
            return F.zip_with(running(both, "int", 0, lambda a, x: a + x), F.slice(gaps, 1, F.size(found)), lambda at, gap: at + F.length(gap))

        def span(m: Column, i: Column, at: Column) -> Column:
            before = cut_out(pieces, F.greatest(at[i] - CONTEXT_WIDTH, F.lit(0)), F.least(at[i], F.lit(CONTEXT_WIDTH)))
            score = F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(before.rlike(CONTEXT[kind]), CONTEXT_SCORE).otherwise(0.0))
            whole = lambda m: F.struct(F.lit(kind).alias("kind"), at[i].alias("start"), (at[i] + F.length(m)).alias("end"), score.alias("score"))
            if kind == "iban":
                return let(_account_code(cut_out(pieces, at[i], F.lit(CODE_WIDTH))), lambda c: F.when(c.isNotNull(), whole(c)))
            return F.when(_confirmed(kind, m), whole(m))

        kept = let(let(F.split(text, pattern, -1), starts), lambda at: F.transform(found, lambda m, i: span(m, i, at)))
        if kind == "iban":
            kept = _apart(F.array_compact(kept).cast(f"array<{SPAN}>"))
        return F.filter(kept, lambda s: s.isNotNull() if kind in BASE_KINDS else s["score"] >= THRESHOLD)

    return let(
        F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array()).cast(f"array<{SPAN}>"),
    )


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """`docs` with `into`: an array of (kind, start, end, score) by kind as in KINDS, then start; code points, end exclusive."""
    value = F.coalesce(F.col(text), F.lit(""))
    spans = let(F.struct(value.alias("whole"), in_pieces(value).alias("pieces")), lambda t: F.concat(*[_spans(k, t["whole"], t["pieces"]) for k in KINDS]))
    return docs.withColumn(into, spans)


def redact(docs: DataFrame, text: str = "text", pii: str = "pii") -> DataFrame:
    """`docs` with each stretch that spans cover replaced by the kind of its first span in brackets, and `pii` dropped.

    Overlapping spans count as one stretch. Null text stays null.
    """
    ordered = F.sort_array(F.transform(F.col(pii), lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def stretches(spans: Column) -> Column:
        """(start, end, kind of the first span): a stretch begins where all spans before have ended."""

        def cut(reach: Column) -> Column:
            first = F.filter(F.transform(spans, lambda s, i: F.when(reach[i] <= s["start"], i)), lambda i: i.isNotNull())
            last = F.array_max(F.transform(spans, lambda s: s["end"]))
            return let(first, lambda f: F.transform(f, lambda i, k: F.struct(spans[i]["start"].alias("start"), F.coalesce(F.get(reach, F.get(f, k + 1)), last).alias("end"), spans[i]["kind"].alias("kind"))))

        return let(running(F.transform(spans, lambda s: s["end"]), "int", 0, lambda a, x: F.greatest(a, x)), cut)

    def shown(stretches: Column) -> Column:
        def told(pieces: Column) -> Column:
            def piece(s: Column, i: Column) -> Column:
                before = F.when(i > 0, stretches[F.greatest(i - 1, F.lit(0))]["end"]).otherwise(0)
                return F.concat(cut_out(pieces, before, s["start"] - before), F.lit("["), F.upper(s["kind"]), F.lit("]"))

            last = F.element_at(stretches, -1)["end"]
            return F.concat(F.array_join(F.transform(stretches, piece), ""), cut_out(pieces, last, F.length(F.col(text)) - last))

        return let(in_pieces(F.col(text)), told)

    whole = let(let(ordered, stretches), shown)
    return docs.withColumn(text, F.when(F.size(pii) > 0, whole).otherwise(F.col(text))).drop(pii)


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with personal data in `text` replaced, and no other change."""
    spans = free_name(docs, "pii")
    return redact(find_pii(docs, text, spans), text, spans).select(*[F.col(f"`{c}`") for c in docs.columns])


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts by base kind, a digest of the base spans, and all spans as text."""
    found = find_pii(docs.select("doc_id", "text"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))
