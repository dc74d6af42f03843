"""The operators as queries over the shared tables, with SQL of the same meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.functions import dates, numbers, text
from lathework.operators import dedupe, filters, joins, ranking, vector

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The day that the queries are asked on.
AS_OF = "1998-06-15"
#: Words that stand for an interest list and an exclusion list.
WANTED, EXCLUDED = ["the", "der", "les", "los", "tion"], ["rent", "schl", "eaux"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of (read) under its name, `read(name)` giving a table."""

    def put(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _as_of():
    return F.lit(AS_OF).cast("date")


def _deadlines(read) -> DataFrame:
    """Orders with the last ship date as a deadline, null where that is in an odd year."""
    last = read("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("deadline"))
    rows = read("orders").join(last, "o_orderkey", "left")
    return rows.withColumn("deadline", F.when(F.year("deadline") % 2 == 0, F.col("deadline")))


_DEADLINES = """(SELECT o.*, CASE WHEN year(d) % 2 = 0 THEN d END AS deadline FROM orders o
  LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS d FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey)"""


@query(f"""SELECT o_orderkey, date_diff('day', DATE '{AS_OF}', deadline::DATE)::INT AS d_day FROM {_DEADLINES}
WHERE CASE WHEN deadline IS NOT NULL THEN deadline::DATE BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 61 ELSE NOT coalesce(o_orderdate::DATE < DATE '{AS_OF}' - 61, false) END""")
def deadline_window(read):
    """Rows within the deadline window, with the days left."""
    rows = filters.deadline_window(_deadlines(read), "deadline", "o_orderdate", _as_of())
    return rows.select("o_orderkey", dates.d_day(F.col("deadline"), _as_of()).alias("d_day"))


@query(f"""SELECT v.i::INT AS position, v.reason, count(t.reason) AS n FROM (VALUES (0, 'past'), (1, 'too_far'), (2, 'old_posted'), (3, 'broken')) v(i, reason)
LEFT JOIN (SELECT CASE WHEN deadline::DATE < DATE '{AS_OF}' THEN 'past' WHEN deadline::DATE > DATE '{AS_OF}' + 61 THEN 'too_far'
  WHEN deadline IS NULL AND o_orderdate::DATE < DATE '{AS_OF}' - 61 THEN 'old_posted' END AS reason FROM {_DEADLINES}) t ON t.reason = v.reason GROUP BY ALL""")
def filter_reason_counts(read):
    """How many rows each reason takes out, in fixed order, zeros shown."""
    verdict = filters.deadline_verdict(F.col("deadline"), F.col("o_orderdate"), _as_of())
    return filters.reason_counts(_deadlines(read), verdict, ["past", "too_far", "old_posted", "broken"])


@query(f"""SELECT doc_id, CASE WHEN contains(text, '{EXCLUDED[0]}') OR contains(text, '{EXCLUDED[1]}') OR contains(text, '{EXCLUDED[2]}') THEN 'excluded'
  WHEN NOT regexp_matches(text, '[A-Za-z]') THEN 'no_letters' WHEN lang <> 'en' AND n_chars > 5000 THEN 'long_foreign' END AS reason FROM documents""")
def first_match_verdict(read):
    """The first of a chain of exclusion rules that holds."""
    body = F.col("text")
    chain = [("excluded", text.first_keyword(body, EXCLUDED).isNotNull()), ("no_letters", ~body.rlike("[A-Za-z]")), ("long_foreign", (F.col("lang") != "en") & (F.col("n_chars") > 5000))]
    return read("documents").select("doc_id", filters.first_match(chain).alias("reason"))


@query("""SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', '', 'g') ORDER BY source, doc_id) AS r FROM documents) WHERE r = 1""")
def exact_dedupe_priority(read):
    """One document for each normalised text: that of the first source."""
    rows = read("documents").select("doc_id", "source", F.md5(text.title_key(F.col("text"))).alias("key"))
    return dedupe.best_of_key(rows, ["key"], [F.col("source"), F.col("doc_id")]).select("doc_id", "source")


@query(f"""SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY (o_orderdate < DATE '{AS_OF}')::INT, o_orderkey) AS r FROM orders) WHERE r = 1""")
def live_replaces_expired(read):
    """One order for each customer and month, one that has not expired if there is one."""
    rows = read("orders").withColumn("month", F.trunc("o_orderdate", "month")).select("o_orderkey", "o_custkey", "o_orderdate", "month")
    return dedupe.live_first(rows, ["o_custkey", "month"], F.col("o_orderdate") < _as_of(), [F.col("o_orderkey")]).select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def upsert_last_wins(read):
    """What keyed upserts leave: each customer's newest order."""
    rows = read("orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return dedupe.last_of_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def new_keys_anti_join(read):
    return joins.new_only(read("documents").select("doc_id", "source"), read("labels"), "doc_id")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'fresh' WHEN quality >= 1 THEN 'stored' ELSE 'below' END AS part FROM documents d LEFT JOIN labels l USING (doc_id)")
def split_by_index(read):
    return joins.split_by_index(read("documents").select("doc_id"), read("labels"), "doc_id", "quality", 1)


@query(f"""SELECT a.o_orderkey, coalesce(a.deadline, l.d) AS deadline FROM {_DEADLINES} a LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS d FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey""")
def restore_missing_deadline(read):
    """Unknown deadlines filled from the index."""
    index = read("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("deadline"))
    return joins.restored(_deadlines(read).select("o_orderkey", "deadline"), index, "o_orderkey", "deadline")


_SNAPSHOT = "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate {} GROUP BY o_custkey"


@query(f"""SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' ELSE 'updated' END AS change, a.n AS old, b.n AS new
FROM ({_SNAPSHOT.format("< DATE '1998-01-01'")}) a FULL JOIN ({_SNAPSHOT.format(">= DATE '1998-01-01'")}) b ON a.o_custkey = b.o_custkey WHERE a.n IS DISTINCT FROM b.n""")
def snapshot_diff(read):
    """Customers added, removed or changed in number of orders between two periods."""
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("date")
    count = lambda rows: rows.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return joins.changes(count(read("orders").where(early)), count(read("orders").where(~early)), "o_custkey", "n")


@query("""SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey)
AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o_orderdate >= DATE '2000-01-01')""")
def stale_candidates(read):
    """Known keys that the latest window lacks."""
    orders = read("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    known = read("customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left_semi")
    return known.join(orders.where(F.col("o_orderdate") >= F.lit("2000-01-01").cast("date")), "c_custkey", "left_anti")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events WHERE event_type = 'error') AND o_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def any_key_history_anti(read):
    """Rows of which no key is in the history."""
    history = read("events").where("event_type = 'error'").select(F.explode(F.array(F.concat(F.lit("e"), "event_id"), F.concat(F.lit("u"), "user_id"))).alias("key"))
    rows = read("orders").select("o_orderkey", F.array(F.concat(F.lit("e"), "o_orderkey"), F.concat(F.lit("u"), "o_custkey")).alias("keys"))
    return joins.without_any_key(rows, "o_orderkey", "keys", history, "key").select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND DATE '2024-01-01' + 14 + (doc_id % 7)::INT > DATE '2024-01-18')")
def unexpired_rejections_anti(read):
    """Rows that no unexpired rejection holds back; expiries are spread over a week."""
    until = F.date_add(F.lit("2024-01-01").cast("date"), (F.lit(14) + F.col("doc_id") % 7).cast("int"))
    cache = read("labels").where("quality = 0").withColumn("until", until)
    return joins.without_unexpired(read("documents").select("doc_id"), cache, "doc_id", "until", F.lit("2024-01-18").cast("date"))


@query(f"""SELECT o_orderkey, d_day FROM (SELECT o_orderkey, date_diff('day', DATE '{AS_OF}', deadline::DATE)::INT AS d_day, CASE WHEN o_custkey % 3 = 0 THEN -1 ELSE date_diff('day', DATE '{AS_OF}' - (o_custkey % 9)::INT, deadline::DATE) END AS before FROM {_DEADLINES})
WHERE d_day > 0 AND ((d_day <= 7 AND (before = -1 OR before > 7)) OR (d_day <= 3 AND (before = -1 OR before > 3)))""")
def milestone_crossing(read):
    """Deadlines that have passed a milestone since they were last seen."""
    last = F.when(F.col("o_custkey") % 3 == 0, -1).otherwise(dates.days_until(F.col("deadline"), F.date_sub(_as_of(), (F.col("o_custkey") % 9).cast("int"))))
    rows = _deadlines(read).select("o_orderkey", dates.days_until(F.col("deadline"), _as_of()).alias("d_day"), last.alias("before"))
    return rows.where(ranking.milestones(F.col("d_day"), F.col("before"))).select("o_orderkey", "d_day")


@query(f"""SELECT o_orderkey, o_totalprice FROM {_DEADLINES} ORDER BY o_orderdate DESC NULLS LAST, date_diff('day', DATE '{AS_OF}', deadline::DATE) ASC NULLS LAST, o_orderkey LIMIT 100""")
def cap_newest_then_nearest(read):
    """The hundred that come first: newest, then with the nearest deadline. The limit is the feature."""
    order = [F.col("o_orderdate").desc_nulls_last(), dates.days_until(F.col("deadline"), _as_of()).asc_nulls_last(), F.col("o_orderkey")]
    return ranking.top(_deadlines(read), order, 100).select("o_orderkey", "o_totalprice")


@query("SELECT doc_id, source, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 5")
def per_source_quota(read):
    return ranking.quota(read("documents").select("doc_id", "source", "n_chars"), ["source"], [F.col("n_chars").desc(), F.col("doc_id")], 5).drop("n_chars")


@query("SELECT doc_id, lang, r::INT AS turn FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 20")
def interleave_groups(read):
    return ranking.interleaved(read("documents").select("doc_id", "lang"), "lang", [F.col("doc_id")], 20)


@query("""SELECT story, list(doc_id ORDER BY n_chars DESC, doc_id)[1] AS lead, list(doc_id ORDER BY n_chars DESC, doc_id)[2:] AS others, count(*)::INT AS size
FROM (SELECT doc_id, n_chars, md5(coalesce(text, '')) AS story FROM documents) GROUP BY story""")
def story_groups(read):
    """Documents of one text: the leading one and the rest."""
    rows = read("documents").select("doc_id", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("story"))
    return ranking.grouped(rows, F.col("story"), [-F.col("n_chars"), F.col("doc_id")], "doc_id")


@query("""SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events GROUP BY user_id HAVING 2 * count(*) FILTER (WHERE event_type IN ('click', 'view')) >= count(*))""")
def majority_drop(read):
    return dedupe.drop_by_majority(read("events").select("event_id", "user_id", "event_type"), "user_id", F.col("event_type").isin("click", "view")).select("event_id", "user_id")


@query("SELECT conv_id, arg_max(text, turn) AS latest, bool_or(role = 'system') AS important, count(*) AS n FROM conversations GROUP BY conv_id")
def thread_latest(read):
    """Each conversation's latest message, whether it holds an important one, and its length."""
    return read("conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("latest"), F.bool_or(F.col("role") == "system").alias("important"), F.count("*").alias("n"))


@query("""SELECT conv_id, turn, coalesce(sum(length(text) - least(length(text), 50)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  >= sum(length(text)) OVER (PARTITION BY conv_id) - 500 AS whole FROM conversations""")
def character_budget(read):
    """Which messages stay whole so that a conversation fits 500 characters: the oldest are cut first."""
    n = F.length("text")
    return ranking.within_budget(read("conversations"), ["conv_id"], [F.col("turn")], n, F.least(n, F.lit(50)), 500).select("conv_id", "turn", "whole")


@query("SELECT doc_id, source, r::INT AS place, ((r - 1) // 10)::INT AS page FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents)")
def pages_of_ten(read):
    return ranking.paged(read("documents").select("doc_id", "source", "lang"), ["source", "lang"], [F.col("doc_id")], 10).drop("lang")


@query("""SELECT query_id, id, round(similarity, 6) AS similarity, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS r FROM (
SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS similarity FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id AND e.label = q.label)) WHERE r <= 5""")
def vector_top_k(read):
    """The five nearest rows of the same label, for every row whose id is divisible by 100."""
    rows = read("embeddings")
    found = vector.nearest(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 5, F.col("label") == F.col("q_label"))
    return found.select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query("SELECT source, n, r::INT AS rank FROM (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS r FROM documents GROUP BY source) WHERE r <= 3")
def source_summary(read):
    """The three largest sources. The limit is the feature."""
    counts = ranking.top(read("documents").groupBy("source").agg(F.count("*").alias("n")), [F.col("n").desc(), F.col("source")], 3)
    return ranking.quota(counts.withColumn("all", F.lit(0)), ["all"], [F.col("n").desc(), F.col("source")], 3).drop("all")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts >= TIMESTAMP '2024-01-25') WHERE r <= 30")
def history_ring(read):
    """The newest thirty entries of each key that have not expired."""
    live = read("events").where(F.col("ts") >= F.lit("2024-01-25").cast("timestamp_ntz"))
    return ranking.quota(live.select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 30).select("user_id", "event_id")


_BARE = r"""regexp_replace(regexp_replace(url, '^[a-z]+://(www\.)?', ''), '^m\.([^/?#]*\.)', '\1')"""
_URL = rf"""regexp_replace(regexp_replace(regexp_extract({_BARE}, '^([^?#]*)', 1), '/amp(/|$)', '\1'), '/+$', '')"""
_PARAMETERS = rf"""[p for p in string_split(regexp_extract({_BARE}, '\?([^#]*)', 1), '&') if p <> '' and not regexp_matches(p, '(?i)^(utm_[a-z]+|ref|fbclid|gclid|cmpid|smid|taid|mod)=')]"""


@query(f"""SELECT min(page_id) AS page_id, u AS url FROM (SELECT page_id, {_URL} || CASE WHEN len({_PARAMETERS}) > 0 THEN '?' || array_to_string({_PARAMETERS}, '&') ELSE '' END AS u FROM pages) GROUP BY u""")
def canonical_urls(read):
    """One page for each canonical address: the first."""
    return read("pages").groupBy(text.canonical_url(F.col("url")).alias("url")).agg(F.min("page_id").alias("page_id"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://(?:www\\.)?([^/?#]+)', 1) AS host FROM pages WHERE NOT (regexp_extract(url, '^[a-z]+://(?:www\\.)?([^/?#]+)', 1) LIKE '%.example.net')")
def blocked_hosts(read):
    rows = read("pages").select("page_id", text.host(F.col("url")).alias("host"))
    return rows.where(~filters.host_is_under(F.col("host"), ["example.net"]))


@query("SELECT doc_id, least((" + " + ".join(f"contains(text, '{k}')::INT" for k in WANTED) + ") / 5.0::DOUBLE, 1.0) AS score, " + "coalesce(" + ", ".join(f"CASE WHEN contains(text, '{k}') THEN '{k}' END" for k in WANTED) + ") AS keyword FROM documents")
def keyword_scores(read):
    body = F.col("text")
    return read("documents").select("doc_id", text.keyword_score(body, WANTED).alias("score"), text.first_keyword(body, WANTED).alias("keyword"))


@query("SELECT event_id, greatest(0.0, least(1.0, (value - 50) / 100)) AS score FROM events")
def clamped_scores(read):
    return read("events").select("event_id", numbers.clamped((F.col("value") - 50) / 100).alias("score"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_fields(read):
    """A field of a JSON object that stands in a text."""
    return read("events").select("event_id", F.try_variant_get(text.json_object(F.concat(F.lit("```json "), "props", F.lit(" ```"))), "$.k", "bigint").alias("k"))


@query("SELECT doc_id, CASE WHEN p > 0 THEN CASE WHEN p > 41 THEN '...' ELSE '' END || substring(text, greatest(p - 40, 1), least(p + 43, length(text)) - greatest(p - 40, 1) + 1) || CASE WHEN p + 43 < length(text) THEN '...' ELSE '' END END AS excerpt FROM (SELECT doc_id, text, instr(text, 'tion') AS p FROM documents)")
def mention_excerpts(read):
    return read("documents").select("doc_id", text.excerpt(F.col("text"), "tion", 40).alias("excerpt"))


@query("SELECT conv_id, turn, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || ' (' || (length(text) - 200) || ' omitted)' ELSE text END AS clipped FROM conversations")
def escaped_and_clipped(read):
    body = F.col("text")
    return read("conversations").select("conv_id", "turn", text.escape_markup(body).alias("escaped"), text.clip(body, 200).alias("clipped"))


@query("SELECT user_id, greatest(1, least(7, greatest(2, ceil((epoch(TIMESTAMP '2024-02-01') - floor(epoch(max(ts)))) / 86400.0) + 1)))::INT AS days FROM events GROUP BY user_id")
def lookback(read):
    """How many days to look back for each user, by the gap since the last event."""
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    return read("events").groupBy("user_id").agg(F.max("ts").alias("ts")).select("user_id", dates.lookback_days(F.lit(2), F.col("ts").cast("timestamp"), now.cast("timestamp")).alias("days"))


@query(f"""SELECT o_orderkey, CASE WHEN n IS NULL THEN 'unknown' WHEN n < 0 THEN 'closed' WHEN n = 0 THEN 'D-Day' ELSE 'D-' || n END AS label FROM (SELECT o_orderkey, date_diff('day', DATE '{AS_OF}', deadline::DATE) AS n FROM {_DEADLINES})""")
def deadline_labels(read):
    return _deadlines(read).select("o_orderkey", dates.d_day_label(F.col("deadline"), _as_of()).alias("label"))


@query("SELECT ts::DATE AS day, event_type, count(*) AS raw, count(*) FILTER (WHERE value < 20) AS stale, count(*) >= 10 AND count(*) FILTER (WHERE value < 20) > 0.3 * count(*) AS canary FROM events GROUP BY 1, 2")
def daily_statistics(read):
    """Rows and stale rows by day and kind, and whether the share is alarming."""
    by = read("events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("raw"), F.count_if(F.col("value") < 20).alias("stale"))
    return by.withColumn("canary", (F.col("raw") >= 10) & (F.col("stale") > 0.3 * F.col("raw")))


@query("SELECT user_id, event_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM events) WHERE ts >= m - INTERVAL 5 DAY")
def ttl_prune(read):
    """What each user's state holds after entries older than five days before the newest are dropped."""
    newest = read("events").groupBy("user_id").agg(F.max("ts").alias("m"))
    return read("events").join(newest, "user_id").where(F.col("ts") >= F.col("m") - F.expr("INTERVAL 5 DAYS")).select("user_id", "event_id")


@query("SELECT event_type, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY coalesce(value, 0) DESC, event_id) AS r FROM events) WHERE r <= 5")
def top_per_category(read):
    rows = read("events").select("event_type", "user_id", "value", "event_id")
    return ranking.quota(rows, ["event_type"], [F.coalesce("value", F.lit(0.0)).desc(), F.col("event_id")], 5).select("event_type", "user_id", "value")


@query("SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds, list_has_any(list(DISTINCT event_type), ['error', 'purchase']) AS guarded FROM events GROUP BY user_id")
def label_sets(read):
    """Each user's set of labels, and whether it meets the guarded ones."""
    kinds = read("events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("kinds"))
    return kinds.withColumn("guarded", F.arrays_overlap("kinds", F.array(F.lit("error"), F.lit("purchase"))))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_windows(read):
    counted = read("events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")


@query()
def fuzzy_titles(read):
    """Parts by name: in order, alike ones of other brands fold into the first."""
    return dedupe.greedy_alike(read("part").select("p_partkey", "p_name", "p_brand"), "p_partkey", "p_name", "p_brand", 0.85)


def _syllables(words):
    """A syllable for each word, so that titles have many different letters."""
    return F.array_join(F.transform(words, lambda w: F.decode(F.unhex(F.hex(F.lit(0xAC00) + F.pmod(F.crc32(w.cast("binary")), F.lit(1200)))), "UTF-16BE")), "")


@query()
def distinct_articles(read):
    """Documents as articles, their first words as titles of a syllable each: equal titles fold, and alike ones of two languages."""
    words = F.slice(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+", 31), 1, 30)  # what follows them stays one piece
    rows = read("documents").select("doc_id", "lang", _syllables(words).alias("title"))
    return dedupe.distinct_articles(rows, "doc_id", "title", F.col("lang").isin("en", "de")).select("doc_id")


@query()
def page_texts(read):
    """The text of each page, without markup, scripts and navigation."""
    return read("pages").select("page_id", text.html_to_text("html").alias("text"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New documents, one for each text, with the first source's priority, the longest first."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.md5(text.title_key(F.col("text"))).alias("key"))
    kept = dedupe.best_of_key(rows, ["key"], [F.col("source"), F.col("doc_id")])
    fresh = joins.new_only(kept, table(spark, sf_dir, "labels"), "doc_id")
    return ranking.top(fresh, [F.col("n_chars").desc(), F.col("doc_id")], 50).select("doc_id", "source", "n_chars")
