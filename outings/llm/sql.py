"""The queries of this folder as DuckDB SQL."""

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
             regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n,
    array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS k
  FROM i, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS t(p) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
keys AS (SELECT DISTINCT n, k FROM win),
dw AS (
  SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS k
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(p) WHERE len(w) >= n),
hit AS (SELECT r, n, p, k FROM dw SEMI JOIN keys USING (n, k)),
n_hit AS (SELECT r, count(DISTINCT q) AS c FROM hit, unnest(range(p, p + n)) AS t(q) GROUP BY r),
items AS (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit JOIN win USING (n, k)),
per AS (SELECT r, count(*) AS c, string_agg(item, ',' ORDER BY item) AS s FROM items GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit.c, 0) AS n_hit, coalesce(per.c, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit.c, 0) > 0 AND 20 * coalesce(n_hit.c, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n_hit USING (r) LEFT JOIN per USING (r)
"""

SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, p, array_to_string(w[p : p + 12], ' ') AS k FROM d, unnest(range(1, len(w) - 11)) AS t(p)
        WHERE len(w) >= 13 AND doc_id IS NOT NULL),
low AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT r, list(DISTINCT q) AS qs FROM win JOIN low USING (k), unnest(range(p, p + 13)) AS t(q) WHERE doc_id > m GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(len(qs), 0) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN qs IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(qs, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""

_DIGITS = "['A','B','C','D','E','F','G','H','I','J','K','L','M','N','O','P','Q','R','S','T','U','V','W','X','Y','Z','2','3','4','5','6','7']"

#: Base32 of a SHA-1: its 160 bits are 32 digits of 5.
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, row_number() OVER () AS r FROM pages),
bits AS (SELECT r, page_id, strlen(html) AS payload_bytes, html,
  array_to_string(list_transform(string_split(sha1(html), ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', c) - 1) + 1, 4)), '') AS b
  FROM p),
d AS (SELECT r, page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
    ({_DIGITS})[CAST(16 * CAST(substr(b, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(b, 5 * i + 3, 1) AS INT)
      + 2 * CAST(substr(b, 5 * i + 4, 1) AS INT) + CAST(substr(b, 5 * i + 5, 1) AS INT) + 1 AS INT)]), '') AS payload_digest FROM bits),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM m
"""

SHARDING = """
WITH RECURSIVE d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) + 1 AS size, coalesce(text, '') AS text,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS INT) AS vslot,
    regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes_hex FROM documents),
b AS (SELECT range AS vslot, range % 16 AS shard, coalesce(bytes, 0) AS bytes
  FROM range(4096) LEFT JOIN (SELECT vslot, sum(size) AS bytes FROM d GROUP BY vslot) s ON s.vslot = range),
k AS (SELECT *, sum(bytes) OVER (PARTITION BY shard ORDER BY bytes DESC, vslot ROWS UNBOUNDED PRECEDING)
  <= ceil(sum(bytes) OVER () / 16) AS kept FROM b),
loads AS (SELECT list(CAST(held AS BIGINT) ORDER BY shard) AS l FROM (
  SELECT range AS shard, coalesce(held, 0) AS held FROM range(16) LEFT JOIN (SELECT shard, sum(bytes) AS held FROM k WHERE kept GROUP BY shard) h ON h.shard = range)),
moving AS (SELECT vslot, CAST(bytes AS BIGINT) AS bytes, row_number() OVER (ORDER BY bytes DESC, vslot) AS i FROM k WHERE NOT kept),
steps(i, l, vslot, shard) AS (
  SELECT CAST(0 AS BIGINT), l, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM loads
  UNION ALL
  SELECT m.i, list_transform(s.l, lambda x, j: CASE WHEN j = list_position(s.l, list_min(s.l)) THEN x + m.bytes ELSE x END),
    m.vslot, CAST(list_position(s.l, list_min(s.l)) - 1 AS BIGINT)
  FROM steps s JOIN moving m ON m.i = s.i + 1),
map AS (SELECT k.vslot, CAST(coalesce(s.shard, k.shard) AS INT) AS shard FROM k LEFT JOIN steps s ON s.vslot = k.vslot),
crc AS (SELECT list(c ORDER BY n) AS t FROM (
  SELECT range AS n, list_reduce(list_prepend(range, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(CAST(3988292384 AS BIGINT), c // 2) ELSE c // 2 END) AS c FROM range(256)))
SELECT doc_id, size, vslot, 'bytes' AS law, shard, CAST(NULL AS INT) AS grown_shard,
  xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(bytes_hex,
      lambda h: CAST('0x' || h AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32,
  row_number() OVER (PARTITION BY shard ORDER BY vslot, doc_id NULLS FIRST, size) - 1 AS slot
FROM d JOIN map USING (vslot), crc
"""

EMBEDDINGS = """
WITH RECURSIVE e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM e),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.95),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
c AS (SELECT a, least(a, min(b)) AS m FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT vec_id, coalesce(k, 0) AS n_links, coalesce(m, vec_id) AS component_id, coalesce(m, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""

EXACT = r"""
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
), ranked AS (
  SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size
  FROM normal WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM ranked
"""
