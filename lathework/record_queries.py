"""Queries of the operators on titles, stories, mail, lists and texts; they join those of `queries` under their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathework.functions import dates
from lathework.functions.deadline_text import deadline_from_text
from lathework.operators import mail, stories, tasks, titles, verdicts
from lathework.queries import AS_OF, _as_of, query
from lathework.sinks import render, tables
from lathework.sources import lists


def _plain(pattern: str) -> str:
    """A pattern as SQL's engine, which has no look-around, says it."""
    return pattern.replace("(?<![A-Za-z])", "(?:^|[^A-Za-z])").replace("(?![A-Za-z])", "(?:[^A-Za-z]|$)").replace("(?iu)", "(?i)").replace("'", "''")


_HAS = {n: f"regexp_matches(text, '{_plain(p)}')" for n, p in (("w", verdicts.AI_WORDS), ("p", verdicts.AI_PHRASES), ("s", verdicts.DRAWINGS), ("t", verdicts.TRADES), ("i", verdicts.INFRASTRUCTURE), ("r", verdicts.RETRIEVAL), ("n", verdicts.NOISE))}


@query(f"""SELECT doc_id, CASE WHEN n AND NOT s THEN 'rejected' WHEN ai AND s THEN 'main' WHEN ai AND t AND i THEN 'infra' WHEN ai AND t THEN 'main' ELSE 'rejected' END AS outcome,
CASE WHEN n AND NOT s THEN NULL WHEN ai AND s THEN 0.8 WHEN ai AND t AND i THEN 0.4 WHEN ai AND t THEN 0.6 END::DOUBLE AS score FROM (
SELECT doc_id, {_HAS["w"]} OR {_HAS["p"]} AS ai, {_HAS["s"]} AS s, {_HAS["t"]} AS t, {_HAS["i"]} AS i, {_HAS["n"]} AS n FROM (SELECT doc_id, coalesce(text, '') || CASE doc_id % 5 WHEN 0 THEN ' AI construction' WHEN 1 THEN ' AI BIM stocks' WHEN 2 THEN ' RAG data centers by contractors' WHEN 3 THEN ' PAID' ELSE '' END AS text FROM documents))""")
def triage_rules(read):
    """Outcome and score by rules; documents get endings that the rules speak of."""
    ends = F.when(F.col("doc_id") % 5 == 0, " AI construction").when(F.col("doc_id") % 5 == 1, " AI BIM stocks").when(F.col("doc_id") % 5 == 2, " RAG data centers by contractors").when(F.col("doc_id") % 5 == 3, " PAID").otherwise("")
    said = verdicts.triage(F.concat(F.coalesce("text", F.lit("")), ends), F.lit(None).cast("string"))
    return read("documents").select("doc_id", said.alias("v")).select("doc_id", "v.outcome", "v.score")


@query("""SELECT doc_id, score, CASE WHEN score IS NULL THEN 'unjudged' WHEN score >= 0.5 THEN 'passed' ELSE 'rejected' END AS outcome FROM (
SELECT d.doc_id, quality::DOUBLE AS score FROM documents d LEFT JOIN labels l USING (doc_id))""")
def judged_by_number(read):
    """Verdicts by number; what no verdict names is unjudged."""
    said = read("labels").select(F.col("doc_id").alias("no"), F.col("quality").cast("double").alias("score"), F.col("doc_id").alias("at"))
    return verdicts.with_judgement(read("documents").select("doc_id"), "doc_id", said, 0.5)


@query("""WITH RECURSIVE s AS (SELECT a.o_orderkey AS no, CASE WHEN b.o_orderkey IS NOT NULL AND b.o_orderkey <= a.o_orderkey AND a.o_orderstatus = b.o_orderstatus THEN b.o_orderkey ELSE a.o_orderkey END AS lead
FROM orders a LEFT JOIN orders b ON b.o_orderkey = a.o_orderkey - a.o_custkey % 40 + 3),
f AS (SELECT no, lead AS story FROM s UNION SELECT f.no, s.lead FROM f JOIN s ON f.story = s.no WHERE s.lead <> f.story) SELECT no, min(story) AS story FROM f GROUP BY no""")
def story_chains(read):
    """Each order's leading order, references followed to their beginning; later, foreign and unknown ones don't count."""
    rows = read("orders").select(F.col("o_orderkey").alias("no"), (F.col("o_orderkey") - F.col("o_custkey") % 40 + 3).alias("said"), "o_orderstatus")
    return stories.story_numbers(rows, "no", "said", "o_orderstatus").select("no", "story")


@query("""SELECT user_id, event_id, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tier, CASE WHEN tier = 1 THEN days ELSE nth END, nth) AS place FROM (
SELECT *, CASE WHEN nth <= 2 THEN 0 WHEN days <= 7 THEN 1 ELSE 2 END AS tier FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM (
SELECT user_id, event_id, CASE WHEN event_type <> 'view' THEN floor(value)::INT - 20 END AS days FROM events) WHERE days IS NULL OR days >= 0))) WHERE place <= 5""")
def soonest_first(read):
    """Each user's five: the first two that are open, then those due within a week, then the rest."""
    rows = read("events").select("user_id", "event_id", F.when(F.col("event_type") != "view", F.floor("value").cast("int") - 20).alias("d"))
    return stories.soonest_first(rows, "user_id", "event_id", F.col("d")).select("user_id", "event_id", "place")


@query("""SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id ORDER BY min({'v': -value, 'e': event_id}), user_id LIMIT 20)""")
def top_stories(read):
    """All events of the twenty users with the highest values. The limit is the feature."""
    return stories.top_stories(read("events").select("event_id", "user_id", "value"), "user_id", [-F.col("value"), F.col("event_id")], 20).select("event_id")


@query("""SELECT 0 AS tier, o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error')
UNION ALL SELECT 1, o_orderkey FROM orders WHERE o_orderpriority LIKE '2%' AND o_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error') AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')""")
def tiers_without_told(read):
    """Two tiers, each without what the history or an earlier tier has told."""
    tier = lambda p: read("orders").where(F.col("o_orderpriority").startswith(p)).select("o_orderkey", "o_custkey")
    told = read("events").where("event_type = 'error'").select(F.col("user_id").alias("o_custkey"))
    first, second = stories.drop_told([tier("1"), tier("2")], "o_custkey", told)
    return first.select(F.lit(0).alias("tier"), "o_orderkey").unionByName(second.select(F.lit(1).alias("tier"), "o_orderkey"))


NAMES = [("a", "tion"), ("b", "the"), ("c", "der")]


@query("SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{k}' END" for k, p in NAMES) + "], lambda x: x IS NOT NULL) AS named FROM documents")
def named_in_text(read):
    """Which of a list of names each document has, in the list's order."""
    return stories.mentions(read("documents").select("doc_id", "text"), F.coalesce("text", F.lit("")), NAMES).select("doc_id", "named")


@query("""SELECT doc_id, CASE WHEN contains(coalesce(left(text, 100), ''), 'tion') THEN 'title' WHEN r > 100 OR text IS NULL THEN 'pending' WHEN contains(text, 'tion') THEN 'body' ELSE 'none' END AS mention FROM (
SELECT *, row_number() OVER (PARTITION BY contains(coalesce(left(text, 100), ''), 'tion') ORDER BY (lang = 'en') DESC, n_chars DESC NULLS LAST, doc_id) AS r FROM documents)""")
def mentions_by_place(read):
    """Where a name is found; a run looks a hundred bodies up. The limit is the feature."""
    rows = read("documents").select("doc_id", "text", "lang", "n_chars", F.array(F.lit("a")).alias("hits"))
    return stories.split_by_mention(rows, F.substring("text", 1, 100), "text", NAMES[:1], F.col("lang") == "en", "n_chars", "doc_id", 100).select("doc_id", "mention")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN [p_brand || ' notice.pdf [1 KB]', p_name || '.hwp'] ELSE [p_name || '.docx'] END AS files FROM part")
def chosen_files(read):
    """Of each part's files those that can be read, notices first."""
    file = lambda *parts: F.struct(F.concat(*parts).alias("name"), F.lit("u").alias("url"))
    even = F.array(file("p_name", F.lit(".hwp")), file("p_brand", F.lit(" notice.pdf [1 KB]")))
    odd = F.array(file("p_brand", F.lit(" x.png")), file("p_name", F.lit(".docx")))
    picked = stories.chosen_attachments(F.when(F.col("p_size") % 2 == 0, even).otherwise(odd), 2, "notice")
    return read("part").select("p_partkey", F.transform(picked, lambda f: f["name"]).alias("files"))


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def source_dates(read):
    """Days written in four ways, read back."""
    written = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy. M. d.")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyyMMdd")).when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    return read("orders").select("o_orderkey", dates.source_date(written).alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate::DATE + INTERVAL 10950 DAY + INTERVAL 86399 SECOND END AS deadline FROM orders")
def deadlines_in_text(read):
    """Deadlines told in sentences: the end of a period, a single day, and a period without an end."""
    day = F.date_add("o_orderdate", 10950)
    begin, end = F.date_format(F.date_sub(day, 20), "yyyy.MM.dd"), F.date_format(day, "yyyy. M. d.")
    told = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("공모기간 "), begin, F.lit(" ~ 예산 소진 시"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("개요. 접수기간 : "), begin, F.lit(" ~ "), end)).otherwise(F.concat(F.lit("제출기한: "), end))
    return read("orders").select("o_orderkey", deadline_from_text(told, F.lit("2025-01-01").cast("date")).alias("deadline"))


@query("""SELECT user_id, CASE WHEN last > TIMESTAMP '2024-01-30 12:00:00' THEN TIMESTAMP '2024-01-29 12:00:00' ELSE greatest(last, TIMESTAMP '2024-01-27 12:00:00') END AS since
FROM (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id)""")
def read_since(read):
    """From when to read for each user: the last run, at most three days back, a day without a credible one."""
    last = read("events").groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("last"))
    return last.select("user_id", dates.watermark(F.col("last"), F.lit("2024-01-30 12:00:00").cast("timestamp")).cast("timestamp_ntz").alias("since"))


@query("SELECT r_name AS region, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey)::INT - 1 AS position, n_name || ' & co' AS title, 'https://x.example/' || n_nationkey AS link FROM nation JOIN region ON n_regionkey = r_regionkey")
def feed_items(read):
    """Entries of a feed for each region, written out and read back."""
    item = F.concat(F.lit("<item><title> "), "n_name", F.lit("  &amp; co</title><link>https://x.example/"), F.col("n_nationkey").cast("string"), F.lit("</link></item>"))
    items = read("nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", item.alias("x")))), lambda s: s["x"]), "").alias("x"))
    pages = read("region").join(items, "r_regionkey").select(F.col("r_name").alias("region"), F.concat(F.lit('<?xml version="1.0"?><rss><channel>'), "x", F.lit("</channel></rss>")).alias("content"))
    return lists.feed_rows(pages, "content").select("region", "position", "title", "link")


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS title, DATE '2031-01-01' + n_nationkey + INTERVAL 86399 SECOND AS deadline, r_name AS organization FROM nation JOIN region ON n_regionkey = r_regionkey")
def json_list(read):
    """Records of JSON answers, one answer for each region."""
    record = F.struct(F.col("n_nationkey").cast("string").alias("ancmId"), F.col("n_name").alias("ancmTl"), F.date_format(F.date_add(F.lit("2031-01-01").cast("date"), F.col("n_nationkey").cast("int")), "yyyy.MM.dd").alias("rcveEndDe"), F.col("r_name").alias("sorgnNm"))
    rows = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey").agg(F.to_json(F.struct(F.collect_list(record).alias("listBsnsAncmBtinSitu"))).alias("body"))
    return lists.json_rows(rows, "body", "r_regionkey", lists.PROJECTS).select("id", "title", "deadline", "organization")


@query("SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN c_name WHEN c_nationkey % 3 = 1 THEN c_name || ' (n' || c_nationkey || '.example)' ELSE 'c' || c_custkey || '@gmail.com' END AS shown FROM customer")
def senders(read):
    """How senders are shown: colleagues, companies, and people without a name."""
    third = F.col("c_nationkey") % 3
    name = F.when(third == 0, F.concat(F.lit("'"), "c_name", F.lit("' via Group"))).when(third == 1, F.col("c_name")).otherwise("")
    domain = F.when(third == 0, "own.example").when(third == 1, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit(".example"))).otherwise("gmail.com")
    return read("customer").select("c_custkey", mail.sender(name, F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@"), domain), "own.example").alias("shown"))


@query("""SELECT conv_id, turn, 'Answer ' || turn || ' to that is long enough' AS body FROM conversations""")
def reply_bodies(read):
    """What is new in replies that quote another message."""
    reply = F.concat(F.lit("Answer "), F.col("turn").cast("string"), F.lit(" to that   is long enough\r\n\r\nOn Monday a person wrote:\n> "), F.coalesce("text", F.lit("")))
    return read("conversations").select("conv_id", "turn", mail.split_quoted(mail.tidy(reply)).alias("s")).select("conv_id", "turn", F.col("s.body").alias("body"))


@query("""SELECT event_id, CASE WHEN event_type = 'signup' OR user_id % 2 = 0 THEN NULL WHEN event_type = 'error' THEN 'declined' WHEN event_type = 'click' THEN 'advert' WHEN event_type = 'view' THEN 'repository' END AS category FROM events""")
def cleanup_categories(read):
    """What messages are cleared away as; protected ones stay."""
    kind = F.col("event_type")
    rows = read("events").select(
        "event_id", F.lit(5).alias("at_ms"), F.when((kind == "signup") | (F.col("user_id") % 2 == 0), F.array(F.lit("STARRED"))).otherwise(F.array().cast("array<string>")).alias("labels"), F.lit("x").alias("from_name"),
        F.when(kind == "view", "notifications@github.com").otherwise("a@x.example").alias("from_addr"), F.when(kind == "error", "Declined: x").when(kind == "click", "(광고) x").otherwise("x").alias("subject"),
    )
    return rows.select("event_id", mail.cleanup_category(F.lit(1)).alias("category"))


@query("""SELECT conv_id::VARCHAR AS thread_id, count(*) FILTER (WHERE role <> 'assistant') AS n, arg_max(turn, turn) FILTER (WHERE role <> 'assistant') AS latest,
coalesce(max(turn) FILTER (WHERE role = 'assistant') > max(turn) FILTER (WHERE role <> 'assistant'), false) AS replied FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role <> 'assistant') > 0""")
def mail_threads(read):
    """Conversations as mail: messages received, the latest, and whether the owner has answered it."""
    none, mine = F.array().cast("array<string>"), F.col("role") == "assistant"
    rows = read("conversations").select(
        F.concat_ws("-", "conv_id", "turn", "role").alias("id"), F.col("conv_id").cast("string").alias("thread_id"), F.lit("n").alias("from_name"), F.when(mine, "me@own.example").otherwise("a@x.example").alias("from_addr"), F.lit("me@own.example").alias("to"),
        F.lit("").alias("cc"), F.lit("s").alias("subject"), F.col("turn").alias("at_ms"), F.when(mine, F.array(F.lit("SENT"))).otherwise(none).alias("labels"), F.lit("").alias("snippet"), F.coalesce("text", F.lit("")).alias("body"), F.lit("").alias("quoted"),
    )
    return mail.threads(rows, 0, "me@own.example", []).select("thread_id", "n", F.col("latest.at_ms").alias("latest"), "replied")


@query(f"""SELECT p_name AS title, p_brand AS board, DATE '{AS_OF}' + p_size - 25 AS due, CASE WHEN p_size = 25 THEN 'today' WHEN p_size < 25 THEN strftime(DATE '{AS_OF}' + p_size - 25, '%Y-%m-%d') || ' over by ' || (25 - p_size) ELSE strftime(DATE '{AS_OF}' + p_size - 25, '%Y-%m-%d') END AS label
FROM part WHERE p_partkey % 2 = 0 AND p_size % 3 > 0""")
def board_tasks(read):
    """A person's active tasks out of boards' properties, with how their days stand."""
    day = F.date_format(F.date_add(_as_of(), F.col("p_size") - 25), "yyyy-MM-dd")
    properties = F.to_json(F.struct(
        F.struct(F.lit("title").alias("type"), F.array(F.struct(F.col("p_name").alias("plain_text"))).alias("title")).alias("Name"),
        F.struct(F.array(F.struct(F.when(F.col("p_partkey") % 2 == 0, "me").otherwise("you").alias("id"))).alias("people")).alias("Assign"),
        F.struct(F.struct(F.when(F.col("p_size") % 3 > 0, "Doing").otherwise("Done").alias("name")).alias("status")).alias("Status"),
        F.struct(F.struct(F.lit("2000-01-01").alias("start"), day.alias("end")).alias("date")).alias("Due"),
    ))
    pages = read("part").select(F.col("p_brand").alias("board"), F.parse_json(properties).alias("properties"))
    return tasks.tasks(pages, "me", {"Assign": "owner"}, ["Doing"], "Part", ["Due"]).select("title", "board", "due", dates.due_label(F.col("due"), _as_of()).alias("label"))


@query("""SELECT doc_id, page::INT AS page, page * 10 + 1 || '~' || least((page + 1) * 10, n) || '/' || n AS range FROM (
SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 AS page, count(*) OVER (PARTITION BY source) AS n FROM documents)""")
def page_ranges(read):
    """Which of how many rows a page shows."""
    return render.page_titles(read("documents").select("doc_id", "source"), ["source"], [F.col("doc_id")]).select("doc_id", "page", "range")


@query("""SELECT string_agg(name, ', ' ORDER BY r) FILTER (WHERE r <= 3) || CASE WHEN count(*) > 3 THEN ' and ' || (count(*) - 3) || ' more' ELSE '' END AS text FROM (
SELECT 'R' || n_regionkey AS name, row_number() OVER (ORDER BY count(*) DESC, n_regionkey DESC) AS r FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey)""")
def source_sentence(read):
    """The three regions with the most customers by name, and how many others there are."""
    rows = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey")
    named = read("region").select(F.col("r_regionkey").alias("source"), (-F.col("r_regionkey")).alias("priority"), F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("name"))
    return render.source_counts(rows, "n_regionkey", named)


@query("""SELECT doc_id AS key, CASE WHEN doc_id % 4 = 0 THEN 'record' WHEN quality >= 1 THEN 'discard' ELSE 'record' END AS change, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE quality END::DOUBLE AS score FROM documents JOIN labels USING (doc_id) WHERE doc_id % 4 = 0 OR quality IS NOT NULL
UNION ALL SELECT doc_id, 'record', 0 FROM documents WHERE doc_id % 4 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def rejection_changes(read):
    """What a run changes in the cache of rejections."""
    rows = read("documents").join(read("labels"), "doc_id", "left").select(F.col("doc_id").alias("key"), F.col("quality").cast("double").alias("score"), F.when(F.col("doc_id") % 4 == 0, F.lit("1990-01-01").cast("timestamp_ntz")).alias("deadline"))
    return tables.cache_changes(rows, 1, _as_of())


@query()
def title_two_passes(read) -> DataFrame:
    """Parts as announcements: equal titles fold, then alike ones of other brands; small parts give way to live ones."""
    rows = read("part").select("p_partkey", "p_name", "p_brand", "p_size")
    return titles.deduplicate(rows, "p_name", "p_brand", "p_partkey", F.col("p_size") > 40).select("p_partkey", "position")


@query()
def title_matches(read) -> DataFrame:
    """For each part the best entry, by title, of an index of the other half of the parts."""
    rows = read("part").select("p_partkey", "p_name", "p_brand")
    held = rows.where("p_brand < 'Brand#3'").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("held"), F.col("p_partkey").alias("order"))
    return titles.match_titles(rows.where("p_brand >= 'Brand#3'"), "p_partkey", "p_name", held, "key", "held", "order")


@query()
def merged_copies(read) -> DataFrame:
    """Documents of one text or of one source and length are copies; their languages are united."""
    rows = read("documents").select("doc_id", F.md5("text").alias("a"), F.concat_ws("-", "source", "n_chars").alias("b"), F.array("lang").alias("langs"))
    return stories.merge_copies(rows, "doc_id", ["a", "b"], ["langs"], []).select("doc_id", "langs")


@query()
def packed_site_queries(read) -> DataFrame:
    """Search queries over the customers' sites, as many sites in each as fit."""
    rows = read("nation").select("n_regionkey", "n_nationkey", F.concat(F.lower(F.regexp_replace("n_name", " ", "")), F.lit(".example")).alias("site"), F.lit("(a OR b)").alias("terms"), F.lit(2).alias("days"))
    return stories.packed_terms(rows, ["n_regionkey"], "n_nationkey", "site", "terms", "days")


@query()
def packed_messages(read) -> DataFrame:
    """Conversations as messages of bounded size, the first turn being the heading."""
    rows = read("conversations").select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role")) == 1).alias("h"), "text")
    return render.messages(rows, "conv_id", "turn", "h", "text", 3, 2000)


@query()
def page_links(read) -> DataFrame:
    """The links of each page with their texts, each address once."""
    return lists.link_rows(read("pages").select("page_id", "html"), "html", ".", 1)
