"""What judges and services answer, as columns: why they stopped, envelopes of batches, strict verdicts, lines of events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def answer(body: Column) -> Column:
    """(stop, text, usable) of a JSON answer with typed blocks: the first text block; a refusal says nothing.

    An answer that was cut off keeps its text but is not `usable` as a summary.
    """
    v = F.try_parse_json(body)
    stop = F.coalesce(F.try_variant_get(v, "$.stop_reason", "string"), F.lit("broken"))
    blocks = F.try_variant_get(v, "$.content", "array<struct<type string, text string>>")
    text = F.try_element_at(F.filter(blocks, lambda b: b["type"] == "text"), F.lit(1))["text"]
    said = F.when(~stop.isin("refusal", "broken"), text)
    return F.struct(stop.alias("stop"), said.alias("text"), (said.isNotNull() & (stop != "max_tokens")).alias("usable"))


def enveloped(body: Column, name: str) -> Column:
    """The payload of a call in the envelope of a batch: of the lines of JSON the first with an entry of that name."""
    lines = F.filter(F.split(body, "\n"), lambda x: F.startswith(F.trim(x), F.lit("[")))
    entries = F.flatten(F.transform(lines, lambda x: F.coalesce(F.try_variant_get(F.try_parse_json(x), "$", "array<array<string>>"), F.array().cast("array<array<string>>"))))
    return F.try_element_at(F.filter(entries, lambda e: F.get(e, 1) == name), F.lit(1))[2]


def strict_verdict(body: Column, kinds: list[str]) -> Column:
    """(no, kind, score) of a verdict that fits the schema, null otherwise: a number, one of the kinds, a score that is a number."""
    v = F.try_parse_json(body)
    no, kind, score = F.try_variant_get(v, "$.no", "int"), F.try_variant_get(v, "$.kind", "string"), F.try_variant_get(v, "$.score", "double")
    numeric = F.schema_of_variant(F.try_variant_get(v, "$.score", "variant")).rlike(r"^(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    fits = no.isNotNull() & kind.isin(*kinds) & numeric
    return F.when(fits, F.struct(no.alias("no"), kind.alias("kind"), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score")))


def event_line(line: Column) -> Column:
    """A line of an event stream for readers: its kind and what it says; a line that is no JSON object stays as it is."""
    v = F.try_parse_json(line)
    kind = F.try_variant_get(v, "$.type", "string")
    return F.when(kind.isNull(), F.trim(line)).otherwise(F.concat(F.lit("["), kind, F.lit("] "), F.coalesce(F.try_variant_get(v, "$.text", "string"), F.lit(""))))
