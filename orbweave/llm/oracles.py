"""DuckDB SQL for the queries that SQL can express over whole tables."""

_WORDS = r"[x FOR x IN regexp_split_to_array({}, '[\x20\x09-\x0D]+') IF x <> '']"

MINHASH = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + 3], ' ') AS k FROM (SELECT doc_id, ws, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [0] ELSE range(len(ws) - 2) END) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (k) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

SUBSTRING = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 20], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 19, 0))) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS place FROM win) WHERE place > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
"""

CHAT = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, length(role) + length(text) + 2 * length(role || text) - length(replace(role, '\', '')) - length(replace(text, '\', '')) - length(replace(role, '<|', '<')) - length(replace(text, '<|', '<')) + 23 AS size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum(size) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS bits, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT) AS BIGINT), 1) FOR i IN range(32)], '') AS payload_digest,
CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM d
"""

#: The CRC-32 of a number's decimals by a table of the remainders of single bytes.
PREFIX_TRIE = rf"""
WITH tab AS (SELECT [list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)] AS tab),
t AS (SELECT conv_id, turn, coalesce(text, '') AS x, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS said FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, x, said, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) AS k FROM t),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, [CAST(ascii(d) AS BIGINT) FOR d IN string_split(CAST(conv_id AS VARCHAR), '')]), lambda c, b: xor(c >> 8, tab[CAST((xor(c, b) & 255) + 1 AS INT)])), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), tab),
b AS (SELECT c.conv_id, k, said, x FROM c JOIN n ON n.conv_id = c.conv_id - c.conv_id % 20 AND k <= h UNION ALL SELECT conv_id, k, said, x FROM n JOIN c USING (conv_id) WHERE k > h),
p AS (SELECT conv_id, 0 AS depth, '' AS key, 0 AS words FROM c UNION ALL SELECT conv_id, row_number() OVER w, string_agg(said, ',') OVER w, len({_WORDS.format("x")}) FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
l AS (SELECT conv_id, max(depth) AS len FROM p GROUP BY conv_id),
u AS (SELECT key, depth, min(conv_id) AS id, count(*) AS n, any_value(words) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = len), '')) AS ends FROM p JOIN l USING (conv_id) GROUP BY key, depth),
up AS (SELECT u.key, u.depth, q.key AS parent FROM u JOIN p q ON q.conv_id = u.id AND q.depth = u.depth - 1),
kids AS (SELECT parent AS key, depth - 1 AS depth, count(*) AS n_children FROM up GROUP BY ALL),
s AS (SELECT a.key, a.depth, sum((u.n - 1) * u.words) AS saved, count(*) FILTER (WHERE n_children IS NULL) AS leaves FROM u LEFT JOIN kids USING (key, depth) JOIN p a ON a.conv_id = u.id AND a.depth <= u.depth GROUP BY a.key, a.depth)
SELECT u.id AS conv_id, CAST(u.depth AS BIGINT) AS depth, o.id AS parent_conv_id, u.n AS n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, u.ends AS ends_sha256
FROM u JOIN s USING (key, depth) LEFT JOIN kids USING (key, depth) LEFT JOIN up USING (key, depth) LEFT JOIN u o ON o.key = up.parent AND o.depth = u.depth - 1
"""
