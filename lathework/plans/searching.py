"""Many searches of some runs as one lazy plan: what each call came to, which entries are kept, and what to warn of.

Answers have been landed before; nothing is fetched here. A call that was refused for asking too much opens its run's
circuit: what the run asked after it counts as skipped, whatever is landed for it. Any other failure costs that call only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.functions.text import clean_title
from lathework.operators import breaker, verdicts
from lathework.operators.filters import host_is_under
from lathework.operators.lineage import cut

#: `no` is unique over all runs and tells the order within one. `status` is ok, throttled, or what went wrong.
CALL = "run string, no bigint, kind string, region string, open boolean, days int, status string"
ENTRY = "no bigint, id string, title string, source string, host string, published_at timestamp"
#: Of several outlets of one host the one with the least `place` counts.
OUTLET = "host string, domain string, outlet string, region string, place int"
#: Rows that an answer holds at most, and hours by which an entry may be older than the days asked for.
FULL, LATE, STALE = 100, 2, 12


@dataclass(frozen=True)
class Search:
    """`items`: kept entries with `outlet`, `region` and their call's `run` and `kind`.

    `calls`: each with `status` (ok, throttled, skipped or the failure), `raw`, `stale` and `kept`. `runs`: health of each
    run (see `breaker.health`). `warnings`: (run, warning, n, total, names).
    """

    items: DataFrame
    calls: DataFrame
    runs: DataFrame
    warnings: DataFrame


def with_outlets(rows: DataFrame, outlets: DataFrame, host: str, region: str, anywhere: Column, blocked: list[str]) -> DataFrame:
    """`rows` with `_outlet` and `_region` of their host; both null where the host is not taken.

    A host is one of those listed in the row's region. Where `anywhere` holds, it may be listed in any region, or not at all
    unless it lies under the domain of an outlet, is blocked, or is missing; then its name is the outlet's.
    """
    first = outlets.groupBy(F.lower("host").alias("_h"), F.col("region").alias("_r")).agg(F.min(F.struct("place", "outlet")).alias("_at"))
    listed = first.groupBy("_h").agg(F.array_sort(F.collect_list(F.struct("_at.place", "_at.outlet", F.col("_r").alias("region")))).alias("_listed"))
    parts = F.split("_h", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    domains = outlets.select(F.lower("domain").alias("_d")).distinct()
    named = rows.withColumn("_h", F.lower(F.coalesce(F.col(host), F.lit(""))))
    below = named.select("_h").distinct().withColumn("_d", F.explode(ends)).join(domains, "_d", "left_semi").select("_h").distinct().withColumn("_below", F.lit(True))
    met = named.join(listed, "_h", "left").join(below, "_h", "left")
    here = F.try_element_at(F.filter("_listed", lambda o: o["region"].eqNullSafe(F.col(region))), F.lit(1))
    any_ = F.try_element_at("_listed", F.lit(1))
    noise = F.coalesce("_below", F.lit(False)) | (F.col("_h") == "")
    if blocked:
        noise = noise | host_is_under(F.col("_h"), blocked)
    free = anywhere & F.col("_listed").isNull() & ~noise
    outlet = F.when(anywhere & any_.isNotNull(), any_["outlet"]).when(free, F.concat(F.lit("web:"), "_h")).when(~anywhere, here["outlet"])
    place = F.when(anywhere & any_.isNotNull(), any_["region"]).when(free | (~anywhere & here.isNotNull()), F.col(region))
    return met.withColumns({"_outlet": outlet, "_region": place}).drop("_h", "_listed", "_below")


def search(calls: DataFrame, entries: DataFrame, outlets: DataFrame, now: Column, home: list[str], start: Column | None = None, blocked: list[str] | None = None, least: int = 10, share: float = 0.7) -> Search:
    """The plan. An entry is kept if its host is taken, it was published within the days asked for (or since `start`), has a
    title, and one in Hangul just where the call's region is of `home`; calls of kind competitor take any language and host.

    Calls of kind health are counted and give nothing. A missing status is a failure; entries without a call are left out;
    an entry found by several calls is kept by each. Empty tables give empty tables.
    """
    refused = F.coalesce(F.col("status") == "throttled", F.lit(False))
    states = breaker.with_states(calls, "run", [F.col("no")], refused, 1)
    told = states.withColumn("status", F.when(F.col("outcome") == "skipped", "skipped").otherwise(F.coalesce("status", F.lit("no answer")))).drop("outcome")
    told = cut(told)
    asked = told.where("status = 'ok'").select("no", "run", "kind", F.col("region").alias("_asked"), F.coalesce("open", F.lit(False)).alias("_open"), "days")
    competitor = F.coalesce(F.col("kind") == "competitor", F.lit(False))
    rows = with_outlets(entries.join(asked, "no"), outlets, "host", "_asked", competitor | F.col("_open"), blocked or [])
    since = start if start is not None else now - F.make_dt_interval(F.col("days"), F.lit(LATE))
    title = clean_title(F.col("title"), F.col("source"))
    language = competitor | verdicts.right_language(title, F.coalesce(F.col("_asked").isin(home), F.lit(False)))
    kept = (F.coalesce("kind", F.lit("")) != "health") & F.col("_outlet").isNotNull() & verdicts.in_window(F.col("published_at"), since, now)
    kept = kept & ~title.rlike(verdicts.EMPTY_TITLE) & language
    stale = F.coalesce(F.col("published_at") < now - F.make_dt_interval(F.col("days"), F.lit(STALE)), F.lit(False))
    judged = cut(rows.withColumns({"title": title, "_kept": F.coalesce(kept, F.lit(False)), "_stale": stale}))
    counts = judged.groupBy("no").agg(F.count("*").alias("raw"), F.count_if("_stale").alias("stale"), F.count_if("_kept").alias("kept"))
    counted = told.join(counts, "no", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("raw", "stale", "kept")}).select(*told.columns, "raw", "stale", "kept")
    outcome = F.when(F.col("status").isin("ok", "skipped"), F.col("status")).otherwise("failed")
    runs = breaker.health(counted.withColumn("outcome", outcome), ["run"], F.col("raw"), F.col("stale"), least, share)
    items = judged.where("_kept").select(*entries.columns, "run", "kind", F.col("_outlet").alias("outlet"), F.col("_region").alias("region"))
    return Search(items, counted, runs, warnings(counted, least, share))


def warnings(calls: DataFrame, least: int = 10, share: float = 0.7) -> DataFrame:
    """(run, warning, n, total, names) for what each run has to be warned of.

    blocked or failed: n of `total` calls failed, with a refusal or without; health_empty: answers to calls of kind health
    that are empty; stale: answers mostly older than asked for; full: open searches that may have been cut off.
    """
    fine = F.col("status") == "ok"
    name = F.concat_ws("/", "region", "kind")
    open_ = F.coalesce("open", F.lit(False))
    found = {
        "health_empty": (fine & (F.col("kind") == "health") & (F.col("raw") == 0), F.col("region")),
        "stale": (fine & (F.col("raw") >= least) & (F.col("stale") > F.col("raw") * share), name),
        "full": (fine & open_ & (F.col("raw") >= FULL), name),
    }
    sums = [F.count("*").alias("total"), F.count_if(~fine).alias("bad"), F.count_if(F.col("status") == "throttled").alias("refused")]
    for k, (holds, of) in found.items():
        sums += [F.count_if(holds).alias(k), F.array_sort(F.collect_set(F.when(holds, of))).alias(f"{k}_names")]
    none = F.array().cast("array<string>")
    failed = F.struct(F.when(F.col("refused") > 0, "blocked").otherwise("failed").alias("warning"), F.col("bad").alias("n"), none.alias("names"))
    others = [F.struct(F.lit(k).alias("warning"), F.col(k).alias("n"), F.col(f"{k}_names").alias("names")) for k in found]
    told = calls.groupBy("run").agg(*sums).select("run", "total", F.explode(F.array(failed, *others)).alias("w"))
    return told.where("w.n > 0").select("run", "w.warning", "w.n", "total", "w.names")


def watermarks(runs: DataFrame, held: DataFrame, now: Column) -> DataFrame:
    """(run, at): a run all of whose calls went well moves to `now`; one that had failures, or did not take place, stays."""
    done = runs.where("complete").select("run", now.alias("_now"))
    return held.select("run", "at").join(done, "run", "full").select("run", F.coalesce("_now", "at").alias("at"))
