"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op1_decontamination"] = r"""
WITH bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item, array_to_string(w[i + 1:i + 10], ' ') AS t, least(len(w), 10) AS n FROM bi),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
lens AS (SELECT DISTINCT n FROM win),
di AS (SELECT doc_id, w, n, unnest(range(0, greatest(len(w) - n, -1) + 1)) AS i FROM dw CROSS JOIN lens WHERE len(w) >= n),
hit AS (SELECT d.doc_id, d.i, d.n, win.item FROM (SELECT doc_id, i, n, array_to_string(w[i + 1:i + n], ' ') AS t FROM di) d JOIN win ON win.t = d.t AND win.n = d.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLES["op9_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
g AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, t FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""

ORACLES["op4_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
d AS (SELECT page_id, CAST(strlen(b) AS BIGINT) AS payload_bytes, sha1(b) AS h, b, max(page_id) OVER (PARTITION BY b) AS keep FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS UBIGINT) >> (35 - 5 * (i % 8))) & 31) AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM d
"""

ORACLES["op5_chat_formatting"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS name, replace(coalesce(text, ''), '<|', '< |') AS body, coalesce(CAST(floor(turn / 256.0) AS BIGINT), -1) AS part FROM conversations),
s AS (SELECT DISTINCT conv_id, name AS speaker FROM t WHERE name <> 'system'),
x AS (SELECT t.conv_id, part, speaker, turn, name, body, name = speaker AS learn,
  CASE WHEN name = speaker THEN '<|assistant|>' || chr(10) WHEN name = 'system' THEN '<|system|>' || chr(10) ELSE '<|user name=' || name || '|>' || chr(10) END AS head,
  body || '<|end|>' || chr(10) AS said FROM t JOIN s ON s.conv_id = t.conv_id),
o AS (SELECT *, sum(length(head) + length(said)) OVER (PARTITION BY conv_id, part, speaker ORDER BY turn, name, body ROWS UNBOUNDED PRECEDING) AS z FROM x)
SELECT conv_id, part, speaker, count(*) AS n_turns, CAST(sum(length(head) + length(said)) AS BIGINT) AS n_chars, CAST(coalesce(sum(length(said)) FILTER (learn), 0) AS BIGINT) AS n_masked,
  coalesce(string_agg((z - length(said)) || '-' || z, ',' ORDER BY turn, name, body) FILTER (learn), '') AS masks,
  sha256(string_agg(head || said, '' ORDER BY turn, name, body)) AS text_sha256
FROM o GROUP BY conv_id, part, speaker
"""

ORACLES["op6_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') || CASE WHEN len(w) < 5 THEN '|' || len(w) ELSE '' END AS s FROM i),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) m USING (doc_id)
"""

ORACLES["op7_suffix_array_dedup"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 - 49 AS BIGINT))) AS i FROM d WHERE length(h) >= 100),
k AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS k FROM p),
m AS (SELECT k, min(doc_id) AS lo FROM k GROUP BY k HAVING min(doc_id) <> max(doc_id)),
s AS (SELECT k.doc_id, k.i FROM k JOIN m USING (k) WHERE k.doc_id > m.lo),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM s),
r AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM g),
spans AS (SELECT doc_id, r, min(i) AS a, max(i) + 50 AS z FROM r GROUP BY doc_id, r),
edges AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS at_end FROM spans),
cut AS (SELECT e.doc_id, sum(z - a) AS gone, count(*) AS n,
  string_agg(substr(h, 2 * before + 1, 2 * (a - before)) || CASE WHEN at_end THEN substr(h, 2 * z + 1) ELSE '' END, '' ORDER BY a) AS kept FROM edges e JOIN d ON d.doc_id = e.doc_id GROUP BY e.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id
"""

ORACLES["op11_spelling_variants"] = r"""
WITH RECURSIVE t AS MATERIALIZED (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS m, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM r GROUP BY ALL),
b AS (SELECT run, m, list_transform(range(0, CAST(length(x) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)) AS b FROM d),
h AS (SELECT run, m, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]))) AS h FROM b CROSS JOIN t),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, m FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
x AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n AS m FROM x a JOIN x b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM x a JOIN v ON v.word = a.cut UNION SELECT v.word, a.word, a.n FROM x a JOIN v ON v.word = a.cut),
s AS (SELECT word, count(*) AS n_near, arg_min(near, (-m, near)) AS top, max(m) AS top_n FROM p GROUP BY word),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 10 * n THEN top END AS form, CASE WHEN top_n >= 10 * n THEN top_n END AS form_n FROM v LEFT JOIN s USING (word)),
c AS (SELECT word, form AS root, 1 AS step FROM f WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL),
e AS (SELECT word, arg_max(root, step) AS root FROM c GROUP BY word)
SELECT f.word, n, n_near, form, form_n, coalesce(e.root, f.word) AS root FROM f LEFT JOIN e USING (word)
"""

ORACLES["op13_line_dedup"] = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
x AS (SELECT doc_id, unnest(a) AS line, unnest(range(0, len(a))) AS pos FROM l),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
g AS (SELECT key, max(doc_id) AS best FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT doc_id, line, pos, coalesce(doc_id <> best, false) AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
