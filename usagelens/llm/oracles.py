"""DuckDB SQL for the queries that SQL can express; written from their definitions alone."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

QUALITY = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
d AS (
  SELECT doc_id, text, {_WORDS.format(text="text")} AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
w AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM d),
tri AS (
  SELECT doc_id, i, a, lead(a, 1) OVER p AS b, lead(a, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
again AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n > 1),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines, len(list_distinct(ws)) AS n_distinct,
         length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^!]+', '', 'g')) AS n_marks,
         length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS n_letters
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR 10 * n_symbols > n_words
            OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)
            OR 100 * n_distinct < 15 * least(n_words, 500)
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 10 * n_upper > 3 * word_chars
            OR 10 * n_marks > n_words
            OR 2 * n_letters < word_chars) AS kept
FROM b
"""

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=_FOLDED)} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
classes AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS class_id
  FROM (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS key FROM s GROUP BY doc_id)),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n AS p ON p.doc_id = x.doc_id JOIN n AS q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, min(reach.b)) AS component_id,
       coalesce(any_value(class_id), d.doc_id) AS class_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN classes ON classes.doc_id = d.doc_id LEFT JOIN reach ON reach.a = d.doc_id
GROUP BY d.doc_id, n.n
"""

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, payload, from_hex(sha1(payload))::BIT::VARCHAR AS bits FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS head FROM h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
            + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to
FROM r
"""

_SHARE = "1 + (1000000000::HUGEINT * ({count} + 5)) // ({n} + 5 * v)"

DIVERGENCE = rf"""
WITH t AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM t),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM t),
k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
kl AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         {_SHARE.format(count="coalesce(c.c, 0)", n="coalesce(n.n, 0)")} AS p, {_SHARE.format(count="k.c", n="kl.n")} AS q
  FROM g JOIN k ON k.lang = g.lang JOIN kl ON kl.lang = g.lang
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
d AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 50
"""
