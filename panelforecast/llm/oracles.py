"""SQL for the queries that SQL can express."""

MIX = """
WITH RECURSIVE
c AS (SELECT source, greatest(1, CAST(floor(sqrt(count(*))) AS BIGINT)) AS w, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i
      FROM documents GROUP BY source),
shares AS (SELECT source, i, w // (SELECT list_reduce(list(w), lambda x, y: greatest(gcd(x, y), 1)) FROM c) AS a FROM c),
lists AS (SELECT list(a ORDER BY i) AS a, CAST(sum(a) AS BIGINT) AS q FROM shares),
steps AS (
  SELECT 0 AS t, a, q, list_transform(a, lambda x: CAST(0 AS BIGINT)) AS done, CAST(NULL AS BIGINT) AS pick, CAST(NULL AS BIGINT) AS k FROM lists
  UNION ALL
  SELECT t + 1, a, q, list_transform(range(1, len(a) + 1), lambda j: done[j] + CASE WHEN j = p THEN 1 ELSE 0 END), p, done[p]
  FROM (SELECT t, a, q, done, list_position(due, list_min(due)) AS p
        FROM (SELECT t, a, q, done, list_transform(range(1, len(a) + 1), lambda j:
                CASE WHEN done[j] < a[j] AND done[j] * q // a[j] <= t THEN ((done[j] + 1) * q + a[j] - 1) // a[j] END) AS due
              FROM steps WHERE t < q))),
plan AS (SELECT pick - 1 AS i, k, t - 1 AS at FROM steps WHERE t > 0),
n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS source_row FROM documents)
SELECT n.doc_id, n.source, n.source_row, n.source_row // 16 AS block,
       CAST((n.source_row // 16) // s.a * (SELECT q FROM lists) + p.at AS BIGINT) AS slot
FROM n JOIN shares s ON n.source IS NOT DISTINCT FROM s.source JOIN plan p ON p.i = s.i AND p.k = (n.source_row // 16) % s.a
"""

REPEATS = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
win AS (SELECT doc_id, p, array_to_string(words[p:p + 19], ' ') AS s
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS p FROM w)),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM win) WHERE n > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM rep),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS kept, count(*) AS n
         FROM each e LEFT JOIN cov c ON e.doc_id = c.doc_id AND e.i = c.i WHERE c.i IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

# the given pages keep what is wanted in one article element, with paragraphs and one heading
PAGES = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS h FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(replace(h, '<br>', ' '), '</?(p|h1)>', chr(1), 'g'), '<[^>]*>', '', 'g') AS h FROM a),
c AS (SELECT page_id, url, regexp_replace(replace(h, '&quot;', '"'), '&amp;?', '&', 'g') AS h FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(list_transform(string_split(h, chr(1)),
        lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""

VECTORS = """
WITH RECURSIVE
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.vec_id, (SELECT count(*) FROM links WHERE links.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c
"""

URLS = r"""
WITH a AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)', 1), '') AS query FROM pages),
rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS r(verdict, h, p)),
b AS (SELECT page_id, host, path, arg_max(struct_pack(verdict := r.verdict, rule := h || p), (length(h || p), length(h))) AS found,
             regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)?$', ''), '\.+$', '') AS bare,
             regexp_replace('/' || path, '/(\.?/)+', '/', 'g') AS way, CASE WHEN query = '?' THEN '' ELSE query END AS query
      FROM a LEFT JOIN rules r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id, host, path, query),
c AS (SELECT *, CASE WHEN bare <> '' THEN bare || way || query END AS canonical, CASE WHEN found.rule IS NOT NULL THEN found END AS f FROM b)
SELECT page_id, host, path, f.rule AS rule,
       coalesce(f.verdict, CASE WHEN canonical IN (SELECT canonical FROM c WHERE f.verdict = 'block' AND canonical IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict
FROM c
"""

# crc32 by its table of 256 steps, over the distinct words
DRAWS = r"""
WITH RECURSIVE
bits AS (SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) AS r(i)
         UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
steps AS (SELECT list(c ORDER BY i) AS step FROM bits WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS words FROM documents),
m AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS words FROM benchmark),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(words) AS w FROM d) AS e GROUP BY doc_id, w),
mw AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM m) AS e GROUP BY w),
hexed AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM mw) AS u),
bytes AS (SELECT w, list_transform(range(1, length(x) // 2 + 1), lambda i: CAST('0x' || x[2 * i - 1:2 * i] AS BIGINT)) AS b FROM hexed),
hashed AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, step[xor(c, x) % 256 + 1])), 4294967295) % 10000 AS bucket
           FROM bytes, steps),
s AS (SELECT bucket, sum(n) AS n FROM dw JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM mw JOIN hashed USING (w) GROUP BY bucket),
g AS (SELECT r.i AS bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0E0) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)
               / ((coalesce(s.n, 0) + 1.0E0) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)))) AS BIGINT) AS gain
      FROM range(10000) AS r(i) LEFT JOIN s ON s.bucket = r.i LEFT JOIN t ON t.bucket = r.i),
x AS (SELECT doc_id, sum(n) AS f, sum(n * gain) AS total FROM dw JOIN hashed USING (w) JOIN g USING (bucket) GROUP BY doc_id),
y AS (SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce((total - ((total % f) + f) % f) // f, 0) AS BIGINT) AS weight,
             CAST('0x' || sha256('2024:' || coalesce(CAST(d.doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h
      FROM d LEFT JOIN x ON d.doc_id = x.doc_id),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5E0) / 4294967296.0E0))) AS BIGINT) AS score FROM y),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS drawn FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN CAST(place AS BIGINT) END AS rank FROM r
"""
