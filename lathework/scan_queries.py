"""Queries of scans, projections, answers, verdicts and titles over the shared tables and texts built from them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lathework.functions import answers, dates, records, searches, titles
from lathework.operators import scans, verdicts
from lathework.queries import AS_OF, _as_of, query


@query("""SELECT n_name AS source, coalesce(k, 0)::BIGINT AS n, CASE WHEN n_nationkey % 7 = 0 THEN 'failed' WHEN coalesce(k, 0) = 0 THEN 'empty' ELSE 'fine' END AS state
FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS k FROM supplier WHERE s_nationkey % 5 <> 1 GROUP BY s_nationkey) ON s_nationkey = n_nationkey""")
def source_states(read):
    """Nations as sources of suppliers: every seventh has failed, a fifth delivers nothing."""
    nation = read("nation")
    rows = read("supplier").where("s_nationkey % 5 <> 1").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return scans.source_health(rows, "n_name", nation.select(F.col("n_name").alias("source")), nation.where("n_nationkey % 7 = 0").select(F.col("n_name").alias("source")))


@query("""SELECT user_id, feed, event_type FROM (SELECT user_id, event_id AS feed, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events
WHERE event_type IN ('view', 'signup')) WHERE k = 1""")
def announced_once(read):
    """Users as entries: the first event of each that is a view or a signup."""
    rows = read("events").select("user_id", F.col("event_id").alias("feed"), "event_type")
    return scans.announced(rows, "user_id", "feed", F.col("event_type"), ["view", "signup"])


@query("""SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, nth)::INT AS rank FROM (SELECT *, row_number() OVER (ORDER BY list, place) AS nth FROM (
SELECT o_orderkey, o_totalprice, list, place, row_number() OVER (PARTITION BY o_orderkey ORDER BY list, place) AS k FROM (
SELECT o_orderkey, o_totalprice, 1 AS list, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders UNION ALL
SELECT o_orderkey, o_totalprice, 2, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) FROM orders) WHERE place <= 50 AND o_orderpriority_ok) WHERE k = 1) WHERE nth <= 20""".replace("AND o_orderpriority_ok", "AND o_orderkey % 3 <> 0"))
def ranked_stories(read):
    """Orders as stories of two ranked lists, the dearest and the latest: the first twenty that fit, best first."""
    orders = read("orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    top = orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(50)
    late = orders.orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(50)
    placed = lambda rows, n, *by: rows.select("o_orderkey", "o_totalprice", F.lit(n).alias("list"), F.row_number().over(Window.orderBy(*by)).alias("place"))
    rows = placed(top, 1, F.col("o_totalprice").desc(), "o_orderkey").union(placed(late, 2, F.col("o_orderdate").desc(), "o_orderkey"))
    return scans.first_then_best(rows, "list", "place", "o_orderkey", F.col("o_orderkey") % 3 != 0, "o_totalprice", 50, 20)


@query("""WITH r AS (SELECT l_suppkey AS source, (l_orderkey // 500)::BIGINT AS page, l_partkey % 40 AS entry FROM lineitem), s AS (SELECT source, entry, min(page) AS page FROM r GROUP BY source, entry),
p AS (SELECT DISTINCT source, page FROM r), z AS (SELECT source, min(page) AS stop FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.source = p.source AND s.page = p.page) GROUP BY source)
SELECT s.source, s.entry, s.page FROM s LEFT JOIN z ON z.source = s.source WHERE stop IS NULL OR page < stop""")
def pages_until_nothing_new(read):
    """Suppliers as sources of pages of orders: read until a page has no part that is new."""
    rows = read("lineitem").select(F.col("l_suppkey").alias("source"), F.floor(F.col("l_orderkey") / 500).alias("page"), (F.col("l_partkey") % 40).alias("entry"))
    return scans.until_nothing_new(rows, "source", "page", "entry")


@query("""SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer
WHERE c_mktsegment <> 'MACHINERY' AND c_name NOT LIKE '%13%') WHERE k <= 12""")
def board_shares(read):
    """Segments as boards: an equal share of sixty rows for each of five, skipped ones left out."""
    rows = scans.without_skipped(read("customer"), "c_mktsegment", "c_name", ["MACHINERY"], ["13"])
    return scans.board_quota(rows, "c_mktsegment", [F.col("c_acctbal").desc(), F.col("c_custkey")], 60, 5).select("c_custkey", "c_mktsegment")


_CACHE = "SELECT o_orderkey AS id, 'u' || (o_custkey % 9) AS url, o_orderdate::DATE AS until FROM orders"


@query(f"""SELECT l_orderkey, l_linenumber, url FROM lineitem LEFT JOIN (SELECT * FROM ({_CACHE}) WHERE until >= DATE '{AS_OF}') ON id = l_orderkey""")
def cached_addresses(read):
    """Lines with the address that the cache holds of their order, if it hasn't run out."""
    cache = read("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("u"), (F.col("o_custkey") % 9).cast("string")).alias("url"), F.col("o_orderdate").cast("date").alias("until"))
    return scans.resolved(read("lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", cache, _as_of())


@query(f"""WITH c AS (SELECT * FROM ({_CACHE}) WHERE until >= DATE '{AS_OF}'), f AS (SELECT l_orderkey AS id, max('u' || (l_suppkey % 9)) AS new_url FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey)
SELECT coalesce(c.id, f.id) AS id, coalesce(new_url, url) AS url, CASE WHEN new_url IS NOT NULL AND new_url IS DISTINCT FROM url THEN DATE '{AS_OF}' + 30 ELSE until END AS until FROM c FULL JOIN f ON c.id = f.id""")
def cache_refreshed(read):
    """The cache of addresses after a run: changed ones live thirty days more, unchanged ones keep their time."""
    cache = read("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("u"), (F.col("o_custkey") % 9).cast("string")).alias("url"), F.col("o_orderdate").cast("date").alias("until"))
    found = read("lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("u"), (F.col("l_suppkey") % 9).cast("string")).alias("url"))
    return scans.cache_update(cache, found, _as_of(), 30)


@query("""SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY f, event_type)::INT AS place FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY user_id, event_type)""")
def kinds_in_order(read):
    """Each user's kinds of events in the order in which they first came."""
    return scans.distinct_in_order(read("events"), ["user_id"], "event_type", "event_id")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE c_nationkey END AS stored, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS again,
CASE c_mktsegment WHEN 'BUILDING' THEN 'works' WHEN 'MACHINERY' THEN 'tools' ELSE c_mktsegment END AS label,
CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE c_name || chr(10) || CASE WHEN c_custkey % 4 = 1 THEN 'own' ELSE c_mktsegment END END AS embedded,
CASE WHEN c_custkey % 5 = 0 THEN 'fallback' ELSE 'u' || c_custkey END AS link FROM customer""")
def projected_records(read):
    """Customers with sentinels for nulls and back, looked-up labels, texts to embed and links with fallbacks."""
    key, name, segment = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    stored = records.with_sentinel(F.when(key % 3 != 0, F.col("c_nationkey")), -1)
    own = F.when(key % 4 == 1, "own").when(key % 4 == 0, " ")
    embedded = records.text_to_embed(name, own, F.when(key % 4 != 0, segment))
    return read("customer").select(
        key, stored.alias("stored"), records.without_sentinel(stored, -1).alias("again"), records.looked_up(segment, {"BUILDING": "works", "MACHINERY": "tools"}).alias("label"),
        embedded.alias("embedded"), records.first_filled(F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("u"), key.cast("string"))), F.lit("fallback")).alias("link"),
    )


_PLACED = "SELECT p_partkey, 'https://a.example' || CASE p_partkey % 6 WHEN 0 THEN '/tag/x' WHEN 1 THEN '/news/sponsored/1' WHEN 2 THEN '/News/2' WHEN 3 THEN '/a/author/b' WHEN 4 THEN '/contributed/3?tag' ELSE '' END AS u, p_brand AS b FROM part"


@query(f"""SELECT p_partkey, lower(split_part(substr(u, 18), '?', 1)) LIKE '/tag/%' OR list_contains(string_split(lower(split_part(substr(u, 18), '?', 1)), '/'), 'author') AS other,
b || CASE WHEN u LIKE '%/sponsored/%' THEN ' (ad)' WHEN u LIKE '%/contributed/%' THEN ' (guest)' ELSE '' END AS name FROM ({_PLACED})""")
def labelled_paths(read):
    """Addresses that are no articles, and outlets' names with a remark by path."""
    n = F.col("p_partkey") % 6
    tail = F.when(n == 0, "/tag/x").when(n == 1, "/news/sponsored/1").when(n == 2, "/News/2").when(n == 3, "/a/author/b").when(n == 4, "/contributed/3?tag").otherwise("")
    url = F.concat(F.lit("https://a.example"), tail)
    named = records.labelled_by_path(F.col("p_brand"), url, {"/sponsored/": "ad", "/contributed/": "guest"})
    return read("part").select("p_partkey", records.not_an_article(url, ["/tag/"], ["author"]).alias("other"), named.alias("name"))


@query("""SELECT a.n_nationkey AS outlet, b.n_nationkey AS asked FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey % 3 = 0 OR a.n_nationkey % 3 = b.n_nationkey % 3""")
def outlets_of_queries(read):
    """Nations as outlets and as queries: a general outlet takes every kind in its region, others their own."""
    kind = lambda c: F.when(F.col(c) % 3 == 0, "general").when(F.col(c) % 3 == 1, "trade").otherwise("web")
    a = read("nation").select(F.col("n_nationkey").alias("outlet"), F.col("n_regionkey").alias("region"))
    b = read("nation").select(F.col("n_nationkey").alias("asked"), F.col("n_regionkey").alias("asked_region"))
    return a.join(b, records.takes_kind(kind("outlet"), F.col("region"), kind("asked"), F.col("asked_region"))).select("outlet", "asked")


@query(f"""SELECT o_orderkey, s AS start, e AS "end", t AS title FROM (SELECT o_orderkey, o_orderdate AS s, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate + INTERVAL 2 DAY WHEN 1 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate + INTERVAL 1 HOUR END AS e,
CASE WHEN o_orderkey % 4 = 0 THEN '(no title)' ELSE o_orderpriority END AS t FROM orders) WHERE s < TIMESTAMP '{AS_OF}' + INTERVAL 3 DAY AND e > TIMESTAMP '{AS_OF}' AND t LIKE '%i%'""")
def calendar_range(read):
    """Orders as events: those with a part in three days, and a word in the title."""
    key, at = F.col("o_orderkey"), F.col("o_orderdate")
    made = records.calendar_event(F.when(key % 4 != 0, F.col("o_orderpriority")).otherwise(" "), at, F.when(key % 3 == 0, at + F.expr("INTERVAL 2 DAY")), F.when(key % 3 == 1, True))
    events = read("orders").select("o_orderkey", made.alias("e")).select("o_orderkey", "e.*")
    low = F.lit(AS_OF).cast("timestamp_ntz")
    return events.where(records.overlaps(F.col("start"), F.col("end"), low, low + F.expr("INTERVAL 3 DAY")) & F.contains("title", F.lit("i"))).select("o_orderkey", "start", "end", "title")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' ~' WHEN 2 THEN '~ ' || strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') || ' ~ ' || strftime(o_orderdate + INTERVAL 9 DAY, '%Y-%m-%d') END AS period,
CASE WHEN o_custkey % 3 + 1 = 2 THEN '2 days' ELSE 'home ' || (o_custkey % 3 + 1) || CASE WHEN o_custkey % 3 = 0 THEN ' day' ELSE ' days' END || ', others 2 days' END AS looked_back,
'[' || month(o_orderdate) || '/' || day(o_orderdate) || '] ' || CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 2 = 0 THEN 'nothing new' ELSE concat_ws(', ', CASE WHEN o_custkey % 2 > 0 THEN 'new 1' END, CASE WHEN o_orderkey % 2 > 0 THEN 'due 1' END) END AS subject,
greatest(date_trunc('day', o_orderdate) + INTERVAL 8 HOUR, o_orderdate) AS post FROM orders""")
def period_texts(read):
    """Periods, spans, subjects and times of posts as text."""
    key, cust, at = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    begin, end = F.when(key % 4 % 2 == 1, at), F.when(key % 4 == 2, at).when(key % 4 == 3, at + F.expr("INTERVAL 9 DAY"))
    return read("orders").select(
        key, records.period_text(begin, end).alias("period"), records.looked_back_text(cust % 3 + 1, F.lit(2)).alias("looked_back"), records.mail_subject(at, cust % 2, key % 2).alias("subject"),
        records.post_time(at, 8, 0).cast("timestamp_ntz").alias("post"),
    )


_ANSWERS = """CASE event_id % 5 WHEN 0 THEN '{"stop_reason":"end_turn","content":[{"type":"thinking","text":"t"},{"type":"text","text":"a' || user_id || '"}]}'
WHEN 1 THEN '{"stop_reason":"max_tokens","content":[{"type":"text","text":"cut"}]}' WHEN 2 THEN '{"stop_reason":"refusal","content":[{"type":"text","text":"no"}]}' WHEN 3 THEN '{"stop_reason":"end_turn","content":[]}' ELSE '{broken' END"""


@query("""SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'max_tokens' WHEN 2 THEN 'refusal' WHEN 4 THEN 'broken' ELSE 'end_turn' END AS stop, CASE event_id % 5 WHEN 0 THEN 'a' || user_id WHEN 1 THEN 'cut' END AS text, event_id % 5 = 0 AS usable FROM events""")
def stopped_answers(read):
    """Why answers stopped, and what of them is usable."""
    events = read("events")
    return events.select("event_id", answers.answer(F.expr(_ANSWERS)).alias("a")).select("event_id", "a.*")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN user_id::INT END AS no, CASE WHEN event_id % 4 = 0 THEN event_type END AS kind, CASE WHEN event_id % 4 = 0 THEN least(value, 1)::DOUBLE END AS score,
CASE event_id % 4 WHEN 1 THEN '[note] x' || user_id ELSE 'raw' || user_id END AS line, CASE WHEN event_id % 3 = 0 THEN 'p' || user_id END AS payload FROM (SELECT * FROM events WHERE event_type IN ('view', 'click') AND value >= 0)""")
def strict_answers(read):
    """Verdicts that fit a schema, lines of events, and payloads out of envelopes."""
    user = F.col("user_id").cast("string")
    n = F.col("event_id") % 4
    verdict = F.when(n == 0, F.concat(F.lit('{"no":'), user, F.lit(',"kind":"'), F.col("event_type"), F.lit('","score":'), F.col("value").cast("decimal(20,6)").cast("string"), F.lit("}")))
    verdict = verdict.when(n == 1, '{"no":1,"kind":"other","score":0.5}').when(n == 2, '{"no":2,"kind":"view","score":true}').otherwise('{"kind":"view","score":0.1}')
    line = F.when(n == 1, F.concat(F.lit('{"type":"note","text":"x'), user, F.lit('"}'))).otherwise(F.concat(F.lit("raw"), user))
    envelope = F.concat(F.lit(")]}'\n\n12\n"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('[["wrb","call","p'), user, F.lit('"],["di","x","y"]]'))).otherwise('[["wrb","else","q"]]'), F.lit("\n5\n[[]"))
    rows = read("events").where("event_type IN ('view', 'click') AND value >= 0")
    made = rows.select("event_id", answers.strict_verdict(verdict, ["view", "click"]).alias("v"), answers.event_line(line).alias("line"), answers.enveloped(envelope, "call").alias("payload"))
    return made.select("event_id", "v.no", "v.kind", F.round("v.score", 4).alias("score"), "line", "payload")


_HEADS, _TAILS = ["(수정공고) 2031년도 ", "[재공고] [공모] ", "", "「", "【정정】"], [" 모집 공고", " 안내", "", " 지원사업 참여기업 모집공고", "공고 수정공고"]


def _case(of: str, values: list[str]) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


@query(rf"""WITH RECURSIVE t AS (SELECT p_partkey, {_case("p_partkey % 5", _HEADS)} || '가온ㆍ나래·' || p_name || (p_partkey % 3) || '차' || {_case("p_partkey // 5 % 5", _TAILS)} AS t FROM part),
o AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(t), '([0-9]{{4}})\s*년도', '\1년'), '^(?:\s*[\[(【〔]\s*(?:수정공고|재공고|정정공고|연장공고|변경공고|수정|정정|연장|변경|재공모|공모|공고)\s*[\])】〕]\s*)+', '') AS t FROM t),
c AS (SELECT p_partkey, regexp_replace(t, '(?:[·ㆍᆞ‧•･・∙⋅]|[^\p{{L}}\p{{N}}])+', '', 'g') AS t FROM o),
r AS (SELECT p_partkey, t, 0 AS k FROM c UNION ALL SELECT p_partkey, regexp_replace(t, '(?:{"|".join(titles.ENDINGS)})$', ''), k + 1 FROM r WHERE regexp_replace(t, '(?:{"|".join(titles.ENDINGS)})$', '') NOT IN ('', t))
SELECT p_partkey, arg_max(t, k) AS canon FROM r GROUP BY p_partkey""")
def canonical_titles(read):
    """Parts as announcements in several spellings: what all spellings share."""
    n = F.col("p_partkey")
    of = lambda i, values: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    title = F.concat(of(n % 5, _HEADS), F.lit("가온ㆍ나래·"), F.col("p_name"), (n % 3).cast("string"), F.lit("차"), of(F.floor(n / 5) % 5, _TAILS))
    rows = read("part").select("p_partkey", title.alias("title")).withColumn("normal", titles.compatible(F.col("title")))
    return rows.select("p_partkey", titles.canon_title(F.col("title"), F.col("normal")).alias("canon"))


@query(r"""SELECT doc_id, regexp_matches(t, '[가-힣]') = (doc_id % 2 = 0) AS language, length(t) <= 3 OR lower(t) IN ('untitled', '속보서비스') AS empty_title,
length(t) < 600 AND regexp_matches(t, '(?i)Just a moment|captcha') AS challenge FROM (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'Untitled' WHEN 1 THEN '속보서비스' WHEN 2 THEN 'Just a moment...' WHEN 3 THEN '가나' WHEN 4 THEN 'CAPTCHA needed' ELSE '건설 ' || lang END AS t FROM documents)""")
def article_checks(read):
    """Titles in the wrong language, titles that say nothing, and pages that ask for proof."""
    n = F.col("doc_id") % 7
    t = F.when(n == 0, "Untitled").when(n == 1, "속보서비스").when(n == 2, "Just a moment...").when(n == 3, "가나").when(n == 4, "CAPTCHA needed").otherwise(F.concat(F.lit("건설 "), F.col("lang")))
    return read("documents").select("doc_id", verdicts.right_language(t, F.col("doc_id") % 2 == 0).alias("language"), t.rlike(verdicts.EMPTY_TITLE).alias("empty_title"), verdicts.challenge_page(t).alias("challenge"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id::INT WHEN 1 THEN 0 WHEN 2 THEN 0 END AS left_days, CASE WHEN event_id % 5 < 4 THEN ts::DATE END AS english FROM events""")
def day_labels(read):
    """Days left by labels, and days as English feeds write them."""
    n = F.col("event_id") % 4
    label = F.when(n == 0, F.concat(F.lit("D-"), F.col("user_id").cast("string"))).when(n == 1, "d-day").when(n == 2, "오늘마감").otherwise("soon")
    k = F.col("event_id") % 5
    english = F.when(k == 0, F.date_format("ts", "MMMM d, yyyy")).when(k == 1, F.date_format("ts", "d MMM yyyy")).when(k == 2, F.date_format("ts", "E, dd MMM yyyy HH:mm:ss 'GMT'"))
    english = english.when(k == 3, F.date_format("ts", "E, d MMM yyyy HH:mm:ss '+0000'")).otherwise("one day")
    return read("events").select("event_id", dates.d_day_from_label(label).alias("left_days"), dates.english_date(english).cast("date").alias("english"))


@query(f"""SELECT o_orderkey, o_orderdate BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND TIMESTAMP '{AS_OF}' + INTERVAL 1 HOUR AS recent, CASE WHEN o_orderkey % 5 = 0 THEN 'none' WHEN o_orderdate::DATE = DATE '{AS_OF}' THEN 'today'
WHEN o_orderdate::DATE < DATE '{AS_OF}' THEN strftime(o_orderdate, '%Y-%m-%d') || ' over by ' || (DATE '{AS_OF}' - o_orderdate::DATE) ELSE strftime(o_orderdate, '%Y-%m-%d') END AS due,
greatest(0, least(least(DATE '{AS_OF}' - o_orderdate::DATE, 60), 60))::INT AS capped FROM orders""")
def publish_windows(read):
    """Orders published within thirty days, and how their days stand to the day of asking."""
    at, day = F.col("o_orderdate"), _as_of()
    now = F.lit(AS_OF).cast("timestamp_ntz")
    late = F.datediff(day, at.cast("date"))
    return read("orders").select(
        "o_orderkey", verdicts.in_window(at, now - F.expr("INTERVAL 30 DAY"), now).alias("recent"), dates.due_label(F.when(F.col("o_orderkey") % 5 != 0, at.cast("date")), day).alias("due"),
        F.greatest(F.lit(0), F.least(late, F.lit(60))).alias("capped"),
    )


@query("""SELECT s_suppkey, t || ' when:' || (s_suppkey % 9 + 1) || 'd' AS search, n_name || ' · ' || s_name || ' × news' || CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '  (제외: stock)' ELSE '  (제외: stock, two words)' END AS readable
FROM (SELECT *, '(intitle:"' || n_name || '" OR ' || s_name || ') intitle:news' || CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' -stock' ELSE ' -intitle:stock -"two words"' END AS t FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def searches_told(read):
    """Suppliers searched for by nation or name, in all outlets, and how a reader is told of it."""
    rows = read("supplier").join(F.broadcast(read("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey") % 3
    out = F.when(k == 0, "").when(k == 1, " -stock").otherwise(' -intitle:stock -"two words"')
    terms = F.concat(F.lit('(intitle:"'), F.col("n_name"), F.lit('" OR '), F.col("s_name"), F.lit(") intitle:news"), out)
    rows = rows.select("s_suppkey", searches.open_search(terms, F.col("s_suppkey") % 9 + 1).alias("search"))
    return rows.withColumn("readable", searches.readable_search(F.col("search")))


# Titles of announcements for `announcement_verdicts`: places in front, matters, ends, and departments.
_PLACES = ["", "[부산] ", "[경기] ", "비수도권 ", "광주 "]
_MATTERS = ["인공지능 바우처", "제조 실증", "농업 기술개발", "제조 데이터", "농업 소프트웨어", "관광 마을", "나들이"]
_ENDS = [" 모집", " 선정 결과 안내", " 입법예고"]
_DEPARTMENTS = ["", "부산광역시", "경기도", "과학기술정보통신부"]


@query("""SELECT doc_id, reason, CASE reason WHEN 'region' THEN region WHEN 'over' THEN over WHEN 'no_keyword' THEN '' ELSE coalesce(bad, good) END AS detail, bad IS NOT NULL AND reason IS NULL AS overridden FROM (
SELECT *, CASE WHEN region IS NOT NULL THEN 'region' WHEN over IS NOT NULL THEN 'over' WHEN m IN (2, 5) THEN 'unwanted' WHEN m = 1 THEN 'mildly_unwanted' WHEN m = 6 THEN 'no_keyword' END AS reason FROM (
SELECT doc_id, m, CASE d WHEN 1 THEN '부산광역시' WHEN 2 THEN NULL ELSE CASE p WHEN 1 THEN '부산' WHEN 3 THEN '비수도권' WHEN 4 THEN '광주' END END AS region, CASE e WHEN 1 THEN '선정 결과' WHEN 2 THEN '입법예고' END AS over,
CASE m WHEN 1 THEN '제조' WHEN 2 THEN '농업' WHEN 3 THEN '제조' WHEN 4 THEN '농업' WHEN 5 THEN '관광' END AS bad, CASE m WHEN 0 THEN '인공지능' WHEN 2 THEN '기술개발' WHEN 3 THEN '데이터' WHEN 4 THEN '소프트웨어' END AS good
FROM (SELECT doc_id, doc_id % 5 AS p, (doc_id // 5) % 7 AS m, (doc_id // 35) % 3 AS e, (doc_id // 105) % 4 AS d FROM documents)))""")
def announcement_verdicts(read):
    """Documents as announcements: each is judged by place, by what has ended, by unwanted matters and by keywords."""
    n = F.col("doc_id")
    of = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    title = F.concat(of(_PLACES, n), of(_MATTERS, F.floor(n / 5)), of(_ENDS, F.floor(n / 35)))
    rows = read("documents").select("doc_id", title.alias("title"), F.lit("").alias("category"), of(_DEPARTMENTS, F.floor(n / 105)).alias("department"))
    return verdicts.with_verdict(rows).select("doc_id", "reason", "detail", "overridden")
