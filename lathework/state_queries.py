"""Queries of ordered state, sessions and an index of vectors; they join the other queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathework.operators import breaker, vector_index
from lathework.plans import searching
from lathework.queries import query
from lathework.streaming import sessions

# A user's events as calls, an error being a failure: two in a row open the circuit, three calls are skipped, one is tried.
# State 0 and 1 are failures in a row, 2 to 4 skip, 5 is on trial.
_CALLS = """WITH RECURSIVE e AS (SELECT *, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
c AS (SELECT event_id, user_id, value, r, bad, 0 AS s FROM e WHERE r = 1 UNION ALL
SELECT e.event_id, e.user_id, e.value, e.r, e.bad, CASE WHEN c.s IN (2, 3, 4) THEN c.s + 1 WHEN NOT c.bad THEN 0 WHEN c.s = 0 THEN 1 ELSE 2 END FROM c JOIN e ON e.user_id = c.user_id AND e.r = c.r + 1),
o AS (SELECT *, CASE WHEN s IN (2, 3, 4) THEN 'skipped' WHEN bad THEN 'failed' ELSE 'ok' END AS outcome FROM c) """


def _states(read):
    return breaker.with_states(read("events"), "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type") == "error", 2, 3)


@query(_CALLS + "SELECT event_id, user_id, outcome FROM o")
def circuit_states(read):
    """What a circuit for each user makes of the user's events."""
    return _states(read).select("event_id", "user_id", "outcome")


@query(_CALLS + """SELECT user_id, count(*) AS total, count(*) FILTER (WHERE outcome <> 'ok') AS failed, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, bool_and(outcome = 'ok') AS complete,
bool_and(outcome <> 'ok') AS all_failed, count(*) FILTER (WHERE outcome = 'ok' AND coalesce(value, 0) >= 10 AND event_id % 30 > coalesce(value, 0) * 0.7) AS canaries FROM o GROUP BY user_id""")
def search_health(read):
    """How each user's calls went, an event's value being the rows it gave and its number telling how many are stale."""
    return breaker.health(_states(read), ["user_id"], F.coalesce("value", F.lit(0.0)), F.col("event_id") % 30)


@query("""SELECT user_id, count(*) AS attempted, count(*) FILTER (WHERE bad) AS failed, count(*) FILTER (WHERE bad AND r <= 3) >= 3 OR (count(*) FILTER (WHERE bad) >= 3 AND 2 * count(*) FILTER (WHERE bad) >= count(*)) AS unavailable
FROM (SELECT *, event_type IN ('error', 'view') AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) GROUP BY user_id""")
def judges_unavailable(read):
    """Users whose first three events fail, or three and half of all."""
    return breaker.unavailable(read("events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type").isin("error", "view"))


@query("""SELECT user_id, min(ts) AS start, max(ts) AS end, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM (
SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, (coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR, true))::INT AS fresh FROM events)) GROUP BY user_id, g""")
def user_sessions(read):
    """Each user's sessions: events with no more than six hours between neighbours."""
    return sessions.sessions(read("events"), ["user_id"], "ts", "6 hours", errors=F.count_if(F.col("event_type") == "error"))


@query("""SELECT event_id, row_number() OVER (PARTITION BY k ORDER BY ts, event_id) = 1 AS is_new FROM (
SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 'thread ' || event_type || ' ' || (event_id % 97) ELSE 'user ' || user_id END AS k FROM events)""")
def conversations_opened(read):
    """Which events open a conversation: those of some kinds are in threads of a channel, the others go to a user's own."""
    threaded = F.col("event_type").isin("view", "click")
    name = sessions.conversation(F.when(threaded, F.col("event_id") % 97), F.col("user_id"), F.col("event_type"))
    return sessions.opened(read("events").withColumn("name", name), "name", [F.col("ts"), F.col("event_id")]).select("event_id", "is_new")


@query("""SELECT query_id, id, round(similarity, 6) AS similarity, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS r FROM (
SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS similarity FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id)) WHERE r <= 5""")
def index_top_k(read):
    """The five nearest of all rows, for every row whose id is divisible by 100, by an index and its bounds: none is lost."""
    rows = vector_index.with_roles(read("embeddings"), "vec_id", "embedding", ["label"])
    found = vector_index.search(vector_index.build(rows), rows.where("vec_id % 100 = 0"), 5, exact=True)
    return found.select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


# Customers as calls of their nations' runs, orders as entries found, suppliers as outlets. What was refused is followed by skipped calls.
_SEARCHES = """WITH c AS (SELECT c_custkey AS no, c_nationkey AS run, 'r' || (c_nationkey % 3) AS asked, CASE c_mktsegment WHEN 'BUILDING' THEN 'health' WHEN 'MACHINERY' THEN 'competitor' ELSE 'topic' END AS kind,
c_custkey % 4 = 0 AS open, 300 * (c_custkey % 5 + 1) AS days, CASE WHEN c_acctbal < -850 THEN 'throttled' WHEN c_acctbal < 0 THEN 'HTTP 500' ELSE 'ok' END AS answer FROM customer),
s AS (SELECT *, CASE WHEN coalesce(bool_or(answer = 'throttled') OVER (PARTITION BY run ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'skipped' ELSE answer END AS status FROM c),
u AS (SELECT 'n' || (s_suppkey % 60) || '.example' AS h, 'r' || (s_nationkey % 3) AS r, arg_min(s_name, s_suppkey) AS outlet, min(s_suppkey) AS place FROM supplier GROUP BY ALL),
a AS (SELECT h, arg_min(outlet, place) AS outlet, arg_min(r, place) AS r FROM u GROUP BY h),
e AS (SELECT o_custkey AS no, o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'x' WHEN o_orderkey % 3 = 0 THEN '가온 소식 ' || o_orderkey ELSE 'news ' || o_orderkey END AS title, o_orderdate AS seen,
'n' || (o_orderkey % 90) || '.example' AS base, o_orderkey % 7 = 0 AS under FROM orders),
m AS (SELECT e.id, e.title, e.seen, s.*, e.base, e.under, s.kind = 'competitor' OR s.open AS anywhere, a.outlet AS a_outlet, a.r AS a_r, u.outlet AS u_outlet FROM e JOIN s ON e.no = s.no AND s.status = 'ok'
LEFT JOIN a ON a.h = e.base LEFT JOIN u ON u.h = e.base AND u.r = s.asked),
t AS (SELECT *, CASE WHEN NOT under AND anywhere AND a_outlet IS NOT NULL THEN a_outlet WHEN anywhere AND a_outlet IS NULL AND base <> 'n89.example' THEN 'web:' || CASE WHEN under THEN 'm.' ELSE '' END || base WHEN NOT under AND NOT anywhere THEN u_outlet END AS outlet,
CASE WHEN anywhere AND a_outlet IS NOT NULL THEN a_r ELSE asked END AS region FROM m),
j AS (SELECT *, seen < TIMESTAMP '1998-08-02' - to_days(days) - INTERVAL 12 HOUR AS old, coalesce(kind <> 'health' AND outlet IS NOT NULL AND seen BETWEEN TIMESTAMP '1998-08-02' - to_days(days) - INTERVAL 2 HOUR AND TIMESTAMP '1998-08-02 01:00:00'
AND title <> 'x' AND (kind = 'competitor' OR (title LIKE '가온%') = (asked = 'r0')), false) AS kept FROM t) """


def _searched(read):
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "health").when(F.col("c_mktsegment") == "MACHINERY", "competitor").otherwise("topic")
    status = F.when(F.col("c_acctbal") < -850, "throttled").when(F.col("c_acctbal") < 0, "HTTP 500").otherwise("ok")
    region = lambda nation: F.concat(F.lit("r"), F.col(nation) % 3)
    host = lambda no: F.concat(F.lit("n"), no, F.lit(".example"))
    key = F.col("c_custkey")
    calls = read("customer").select(F.col("c_nationkey").alias("run"), key.alias("no"), kind.alias("kind"), region("c_nationkey").alias("region"), (key % 4 == 0).alias("open"), (300 * (key % 5 + 1)).cast("int").alias("days"), status.alias("status"))
    n = F.col("o_orderkey")
    title = F.when(n % 11 == 0, "x").when(n % 3 == 0, F.concat(F.lit("가온 소식 "), n)).otherwise(F.concat(F.lit("news "), n))
    named = F.concat_ws(" - ", title, F.col("o_orderpriority"), F.col("o_orderpriority"))
    place = F.concat(F.when(n % 7 == 0, "M.").otherwise(""), host(n % 90))
    entries = read("orders").select(F.col("o_custkey").alias("no"), n.alias("id"), named.alias("title"), F.col("o_orderpriority").alias("source"), place.alias("host"), F.col("o_orderdate").alias("published_at"))
    site = host(F.col("s_suppkey") % 60)
    outlets = read("supplier").select(site.alias("host"), site.alias("domain"), F.col("s_name").alias("outlet"), region("s_nationkey").alias("region"), F.col("s_suppkey").alias("place"))
    return searching.search(calls, entries, outlets, F.lit("1998-08-02").cast("timestamp_ntz"), ["r0"], blocked=["n89.example"])


@query(_SEARCHES + "SELECT id, no, run, kind, title, outlet, region FROM j WHERE kept")
def searched_entries(read):
    """Orders that the searches of customers keep, by host, time, title and language, with the outlets that have them."""
    return _searched(read).items.select("id", "no", "run", "kind", "title", "outlet", "region")


@query(_SEARCHES + """, k AS (SELECT no, count(*) AS raw, count(*) FILTER (WHERE old) AS stale FROM j GROUP BY no), w AS (SELECT s.*, coalesce(raw, 0) AS raw, coalesce(stale, 0) AS stale FROM s LEFT JOIN k USING (no)),
x AS (SELECT run, CASE WHEN bool_or(status = 'throttled') THEN 'blocked' ELSE 'failed' END AS warning, count(*) FILTER (WHERE status <> 'ok') AS n, '' AS names FROM w GROUP BY run UNION ALL
SELECT run, 'health_empty', count(*), string_agg(DISTINCT asked, ',') FROM w WHERE status = 'ok' AND kind = 'health' AND raw = 0 GROUP BY run UNION ALL
SELECT run, 'stale', count(*), string_agg(DISTINCT asked || '/' || kind, ',' ORDER BY asked || '/' || kind) FROM w WHERE status = 'ok' AND raw >= 10 AND stale > raw * 0.7 GROUP BY run UNION ALL
SELECT run, 'full', count(*), string_agg(DISTINCT asked || '/' || kind, ',' ORDER BY asked || '/' || kind) FROM w WHERE status = 'ok' AND open AND raw >= 100 GROUP BY run)
SELECT run, warning, n, total, names FROM x JOIN (SELECT run, count(*) AS total FROM w GROUP BY run) USING (run) WHERE n > 0""")
def search_warnings(read):
    """What each nation's run has to be warned of: refusals, failures, empty checks, answers older than asked for."""
    return _searched(read).warnings.withColumn("names", F.array_join("names", ","))
