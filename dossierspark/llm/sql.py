"""SQL statements of the operators that SQL can express."""

#: Words by white space, A-Z lower-cased, five-word shingles, links at 80 %, smallest id reachable.
_SETS = """
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\\x20\\x09-\\x0D]+') AS w FROM {source})"""

JACCARD = f"""
WITH RECURSIVE {_SETS.format(text="text", source="documents")},
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.component_id
FROM (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) m
JOIN documents d USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

CONTAINED = r"""
WITH words AS (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 1, item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM benchmark WHERE text IS NOT NULL),
widths AS (SELECT DISTINCT least(len(w), 5) AS width FROM words WHERE side = 1 AND len(w) > 0),
shingles AS (
  SELECT DISTINCT side, id, array_to_string(w[i:i + width - 1], ' ') AS s
  FROM (SELECT side, id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM words, widths WHERE len(w) >= width AND (side = 0 OR width = least(len(w), 5)))),
sizes AS (SELECT id, count(*) AS n FROM shingles WHERE side = 1 GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, any_value(n) AS item_shingles, count(*) AS shared
FROM shingles i JOIN shingles d ON d.s = i.s AND d.side = 0 JOIN sizes z ON z.id = i.id
WHERE i.side = 1 GROUP BY d.id, i.id HAVING 5 * count(*) >= 4 * any_value(n)
"""

REPUTATION = r"""
WITH p AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (
  SELECT *, CASE WHEN strpos(host, '.') > 0 THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host END AS domain,
         string_split(host, '.')[-1] AS suffix, try_cast(nullif(regexp_extract(path, '/([0-9]+)(?:[.][a-z]+)?/?$', 1), '') AS BIGINT) AS doc_id FROM q),
known AS (SELECT doc_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels
          WHERE quality IS NOT NULL AND toxic IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, count(*) AS n, sum(good)::DOUBLE AS good
      FROM r JOIN known USING (doc_id) GROUP BY host),
o AS (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM h),
s0 AS (SELECT suffix, sum(n)::DOUBLE AS n, sum(good) AS good, any_value(m) AS m FROM h, o GROUP BY suffix),
k0 AS (SELECT coalesce(1 / greatest(0.001, least(0.5, (sum(n * (good / n - m) ** 2) - sum(m * (1 - m))) / nullif(sum((n - 1) * m * (1 - m)), 0))) - 1, 1) AS k FROM s0),
s AS (SELECT suffix, (good + k * m) / (n + k) AS rate, n + k AS strength FROM s0, k0),
d0 AS (SELECT h.suffix, domain, sum(n)::DOUBLE AS n, sum(good) AS good, any_value(s.rate) AS m FROM h JOIN s USING (suffix) GROUP BY h.suffix, domain),
k1 AS (SELECT coalesce(1 / greatest(0.001, least(0.5, (sum(n * (good / n - m) ** 2) - sum(m * (1 - m))) / nullif(sum((n - 1) * m * (1 - m)), 0))) - 1, 1) AS k FROM d0),
d AS (SELECT suffix, domain, (good + k * m) / (n + k) AS rate, n + k AS strength FROM d0, k1),
h0 AS (SELECT host, h.n, h.good, d.rate AS m FROM h JOIN d USING (suffix, domain)),
k2 AS (SELECT coalesce(1 / greatest(0.001, least(0.5, (sum(n * (good / n - m) ** 2) - sum(m * (1 - m))) / nullif(sum((n - 1) * m * (1 - m)), 0))) - 1, 1) AS k FROM h0),
t AS (SELECT host, (good + k * m) / (n + k) AS rate, n + k AS strength FROM h0, k2),
v AS (
  SELECT r.*, coalesce(t.rate, d.rate, s.rate, o.m) AS good_rate, coalesce(t.strength, d.strength, s.strength, 0) AS strength
  FROM r CROSS JOIN o LEFT JOIN t USING (host) LEFT JOIN d ON d.domain = r.domain LEFT JOIN s ON s.suffix = r.suffix),
x AS (
  SELECT *, good_rate + 1.645 * sqrt(good_rate * (1 - good_rate) / (strength + 1)) AS upper_bound,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM v)
SELECT page_id, url, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN upper_bound < 0.5 THEN 'block' ELSE 'allow' END AS verdict, good_rate, upper_bound
FROM x
"""

#: Terms are runs of a-z, digits and characters beyond ASCII, A-Z lower-cased; whole-number scores.
RANKED = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
lengths AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM words),
totals AS (SELECT count(*) FILTER (n > 0) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM lengths),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS t
  FROM benchmark),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM words) WHERE t IN (SELECT t FROM asked) GROUP BY doc_id, t),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS wt FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), totals),
entries AS (
  SELECT doc_id, t, wt * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nn) // ll)))) AS v
  FROM tf JOIN weights USING (t) JOIN lengths USING (doc_id), totals),
scores AS (SELECT item_id, doc_id, CAST(sum(v) AS BIGINT) AS score FROM asked JOIN entries USING (t) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 50
"""

ARCHIVED = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
