"""SQL of the same meaning as the corpus queries, as far as SQL has what they need: there is no tokenizer and no regular expression that looks around in it."""

from __future__ import annotations

_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _split(text: str) -> str:
    return rf"[w FOR w IN string_split_regex({text}, '[\x20\x09-\x0D]+') IF w <> '']"


CHAT = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
        (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')),
m AS (SELECT *, length('### ') + length(regexp_replace(role, '(\\|###|</turn>|\n)', '\\\1', 'g')) + 1 + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + length('</turn>') + 1 AS chars FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id"""

NEAR = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_split(_SMALL)} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
m AS (SELECT node, min(seen) AS least FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least, d.doc_id) AS component_id, coalesce(d.doc_id = coalesce(least, d.doc_id), true) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.node = d.doc_id"""

QUALITY = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, {_split("coalesce(text, '')")} AS w FROM documents),
x AS MATERIALIZED (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
twice AS (SELECT i, doc_id FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM x) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
f AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, v, count(*) AS n FROM (SELECT doc_id, unnest(w) AS v FROM d) WHERE length(v) > 1 GROUP BY doc_id, v) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        [y FOR y IN string_split(t, chr(10)) IF regexp_matches(y, '[^\x20\x09-\x0D]')] AS lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(f.n, 0) AS top_word
      FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN f ON f.doc_id = d.doc_id),
k AS (SELECT *, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 20 * word_chars OR (n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines)
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 100 * top_word > 40 * n_words) AS kept
FROM k"""

SHARDS = """
WITH d AS MATERIALIZED (SELECT doc_id, strlen(coalesce(text, '')) AS size, lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT), 60, '0') AS bits FROM documents),
x AS MATERIALIZED (SELECT doc_id, depth, substr(bits, 1, depth) AS shard, size FROM d, (SELECT unnest(range(61))::INT AS depth)),
s AS (SELECT depth, shard, sum(size)::BIGINT AS bytes FROM x GROUP BY depth, shard)
SELECT doc_id, shard, depth AS shard_depth, bytes AS shard_bytes, bytes <= 1048576 AS shard_fits FROM
  (SELECT x.doc_id, x.shard, x.depth, s.bytes, row_number() OVER (PARTITION BY x.doc_id ORDER BY x.depth) AS k
   FROM x JOIN s ON s.depth = x.depth AND s.shard = x.shard WHERE s.bytes <= 1048576 OR x.depth = 60) WHERE k = 1"""

REPEATS = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS MATERIALIZED (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
f AS (SELECT s, min(doc_id) AS first FROM x GROUP BY s HAVING count(*) > 1),
g AS (SELECT x.doc_id, i FROM x JOIN f ON f.s = x.s WHERE f.first < x.doc_id),
o AS (SELECT doc_id, i, coalesce(i > lag(i) OVER w + 50, true) AS opens FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, min(i) AS b, max(i) + 50 AS e FROM (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o) GROUP BY doc_id, run),
p AS (SELECT d.doc_id, h, b, e, coalesce(lag(e) OVER w, 0) AS before, lead(b) OVER w IS NULL AS last FROM d LEFT JOIN r ON r.doc_id = d.doc_id WINDOW w AS (PARTITION BY d.doc_id ORDER BY b)),
k AS (SELECT doc_id, any_value(length(h) // 2)::BIGINT AS n_bytes, coalesce(sum(e - b), 0)::BIGINT AS n_removed, count(b)::BIGINT AS n_spans,
        string_agg(CASE WHEN b IS NULL THEN h ELSE substr(h, 2 * before + 1, 2 * (b - before)) || CASE WHEN last THEN substr(h, 2 * e + 1) ELSE '' END END, '' ORDER BY b) AS kept
      FROM p GROUP BY doc_id)
SELECT doc_id, n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM k"""

_PLAIN = rf"[w FOR w IN string_split_regex({_SMALL}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF w <> '']"

LEAKS = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_PLAIN} AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, {_PLAIN} AS w FROM benchmark WHERE item_id IS NOT NULL),
y AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
x AS MATERIALIZED (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM y) WHERE len(w) >= n)),
h AS MATERIALIZED (SELECT x.doc_id, x.i, x.n, y.item_id FROM x JOIN y ON y.n = x.n AND y.s = x.s),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""
