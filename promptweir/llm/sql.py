"""SQL twins of the queries that SQL can express, by plain comparison of everything."""

OP1 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
steps AS (
  SELECT *, row_number() OVER w AS place, lag(role) OVER w AS past FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (
  SELECT *, 4 + length(role) + 2 + 8
    + length(text) + (length(text) - length(replace(text, '\', '')))
    + (length(text) - length(replace(text, '</turn>', ''))) // 7
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) AS chars
  FROM steps),
-- States: 0 start, 1 ready, 2 asked, 3 answered; eights count the turns that had no move.
machine AS (
  SELECT conv_id, walk // 8 AS violations, walk % 8 AS state FROM (
    SELECT conv_id, list_reduce(list(CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 WHEN 'assistant' THEN 3 ELSE 0 END ORDER BY place),
      lambda s, r: CASE WHEN s % 8 = 0 AND r IN (1, 2) THEN s + r WHEN s % 8 = 1 AND r = 2 THEN s + 1
        WHEN s % 8 = 2 AND r = 3 THEN s + 1 WHEN s % 8 = 3 AND r = 2 THEN s - 1 ELSE s + 8 END, CAST(0 AS BIGINT)) AS walk
    FROM steps GROUP BY conv_id))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, any_value(violations) AS violations, any_value(state) = 3 AND any_value(violations) = 0 AS valid
FROM sized JOIN machine USING (conv_id) GROUP BY conv_id
"""


OP3 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id) AS place,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS original
  FROM pages),
d AS (SELECT *, strlen(html) AS n, sha1(html) AS hex FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + (CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) % 32]),
    'string_agg', '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN original END AS refers_to
FROM d
"""

CLOSURE = """
reach AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
  UNION SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
"""

OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]))
    WHEN len(w) > 0 THEN [w] ELSE [] END AS s FROM w),
k AS (SELECT min(doc_id) AS doc_id, len(list_sort(s)) AS n, list_sort(s) AS s FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
copies AS (SELECT s.doc_id, k.doc_id AS of FROM s JOIN k ON list_sort(s.s) = k.s WHERE s.doc_id <> k.doc_id),
t AS (SELECT doc_id, n, unnest(s) AS t FROM k),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.n AS m, y.n AS n, count(*) AS common
  FROM t x JOIN t y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs WHERE 100 * common >= 85 * (m + n - common)
  UNION ALL SELECT of, doc_id FROM copies),
""" + CLOSURE + """
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.b, s.doc_id)) AS component_id
FROM s LEFT JOIN least l ON s.doc_id = l.a
"""

OP6 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
n AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id),
""" + CLOSURE + """
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(l.b, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(l.b, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.id = vec_id LEFT JOIN least l ON l.a = vec_id
"""

OP8 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

OP12 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND c.keeper <> k.doc_id AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP13 = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
f AS (SELECT count(*) AS N, sum(n)::BIGINT AS L FROM n),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (
  SELECT term, floor(1000 * ln((2 * f.N + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM i) GROUP BY term), f),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n.n * f.N) // f.L)))))::BIGINT AS score
  FROM i JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), f GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""

OP11 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, 
    xor(4294967295, list_reduce(
      flatten(list_transform(range(1, 1 + length(CAST(doc_id AS VARCHAR))), lambda j: [ord(CAST(doc_id AS VARCHAR)[j]), -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, 4294967295)) AS h
  FROM documents),
e AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a, 1 + (n - CASE WHEN n > 0 THEN g % n END) // (3 + g % 8) AS p FROM e),
o AS (
  SELECT doc_id, n, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS w
  FROM (SELECT *, unnest(range(0, n)) AS i FROM f)),
same AS (
  SELECT x.doc_id, x.i, y.i - x.i AS p FROM o x JOIN o y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
islands AS (
  SELECT doc_id, p, min(i) AS s, count(*) + p AS len
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM same) GROUP BY doc_id, p, k
  HAVING count(*) + p >= greatest(24, 3 * p)),
runs AS (
  SELECT * FROM islands r WHERE NOT EXISTS (
    SELECT 1 FROM islands q WHERE q.doc_id = r.doc_id AND q.p < r.p AND r.p % q.p = 0 AND q.s <= r.s AND q.s + q.len >= r.s + r.len)),
best AS (
  SELECT r.*, row_number() OVER (PARTITION BY r.doc_id ORDER BY len::DOUBLE / r.p DESC, s, r.p) AS place FROM runs r),
told AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS runs FROM runs GROUP BY doc_id),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s + p, s + len)) AS i FROM runs),
kept AS (
  SELECT o.doc_id, string_agg(o.w, ' ' ORDER BY o.i) AS text FROM o LEFT JOIN gone ON gone.doc_id = o.doc_id AND gone.i = o.i
  WHERE gone.i IS NULL GROUP BY o.doc_id)
SELECT f.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.len AS length, b.p AS period,
  CAST(1000 * b.len // b.p AS BIGINT) AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
  sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM f LEFT JOIN best b ON b.doc_id = f.doc_id AND b.place = 1 LEFT JOIN told ON told.doc_id = f.doc_id LEFT JOIN kept ON kept.doc_id = f.doc_id
"""
