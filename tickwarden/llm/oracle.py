"""DuckDB statements for the corpus queries that SQL can express.

The others (packing, robust estimates, mixtures, classifier, SimHash,
token ids) are tested against brute force and on held-out rows.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

OP1 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex FROM p
), h AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS head FROM d
)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to
FROM h
"""

OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w, row_number() OVER () AS r
  FROM embeddings WHERE vec_id IS NOT NULL
    AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank,
    vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""

OP5 = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len({_WORDS}), 0)::BIGINT AS size, md5(coalesce(text, '')) AS mark,
    row_number() OVER (PARTITION BY source, doc_id, coalesce(text, '')) AS number FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3, 1, 2][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS w
  FROM d GROUP BY source
), o AS (  -- sources in the order in which a rising level caps them
  SELECT *, row_number() OVER (ORDER BY source_size / w, source) AS k FROM s
), c AS (  -- the level if the k sources before this one are capped
  SELECT *, ((1.5::DOUBLE * sum(source_size) OVER ()
              - coalesce(2 * sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
             / (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE) AS level
  FROM o
), l AS (
  SELECT arg_min(level, k) AS level FROM c WHERE source_size > 0 AND w * level < 2 * source_size
), t AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE, w * l.level) AS target FROM s, l
), r AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || mark || '|' || number), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

OP7 = f"""
WITH d AS (
  SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents
), n AS (
  SELECT doc_id, w, i, CASE WHEN i > 1 THEN ws[i - 1] END AS v
  FROM (SELECT doc_id, ws, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d)
), c1 AS (SELECT w, count(*) AS n FROM n GROUP BY w
), c2 AS (SELECT v, w, count(*) AS n FROM n WHERE v IS NOT NULL GROUP BY v, w
), t AS (SELECT count(*) AS total FROM n
), x AS (
  SELECT n.doc_id, n.i > 1 AND c2.n < 2 AS off,
    CASE WHEN n.i > 1 AND c2.n >= 2 THEN ln(c2.n::DOUBLE / cv.n)
         ELSE ln(cw.n::DOUBLE / total) + CASE WHEN n.i > 1 THEN ln(0.4::DOUBLE) ELSE 0 END END AS s
  FROM n CROSS JOIN t JOIN c1 cw ON cw.w = n.w LEFT JOIN c1 cv ON cv.w = n.v
  LEFT JOIN c2 ON c2.v = n.v AND c2.w = n.w
), g AS (SELECT doc_id, sum(s) AS s, count(*) FILTER (WHERE off) AS b FROM x GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(b, 0)::BIGINT AS backed_off,
  floor(coalesce(s, 0) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS log_score
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""

# crc32 of the decimal id, bit by bit (0xEDB88320 = 3988292384)
OP11 = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS txt,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), z AS (
  SELECT c, count(*) AS n, c - ((c % 20) + 20) % 20 AS base,
    xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
                               lambda v, w: xor(v >> 1, 3988292384::BIGINT * (v & 1)))), 4294967295::BIGINT) % 4 AS h
  FROM t GROUP BY c
), r AS (
  SELECT z.c, t.k AS d, t.role, t.txt FROM z JOIN t ON t.c = z.base AND t.k <= z.h
  UNION ALL
  SELECT z.c, t.k - z.h + least(z.h, coalesce(b.n, 0)), t.role, t.txt
  FROM z JOIN t ON t.c = z.c AND t.k > z.h LEFT JOIN z b ON b.c = z.base
), s AS (
  SELECT c, d, len(regexp_extract_all(txt, '[^\x20\x09-\x0D]+')) AS w,
    sha256(string_agg(sha256(len(role) || '|' || role || txt), '') OVER (PARTITION BY c ORDER BY d)) AS node
  FROM r
  UNION ALL SELECT c, 0, 0, 'root' FROM z
), e AS (
  SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS parent, d = max(d) OVER (PARTITION BY c) AS ends FROM s
), g AS (
  SELECT node, any_value(d) AS depth, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM e GROUP BY node
), f AS (
  SELECT g.*, coalesce(k.n, 0) AS n_children FROM g LEFT JOIN (
    SELECT parent, count(*) AS n FROM g WHERE parent IS NOT NULL GROUP BY parent) k ON k.parent = g.node
), u AS (  -- the nodes on the way from the root to each node
  SELECT s.node, sum((f.n_children = 0)::INT) AS n_leaves, sum((f.n_convs - 1) * f.w) AS saved_tokens
  FROM f JOIN s ON s.c = f.conv_id AND s.d <= f.depth GROUP BY s.node
)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs,
  f.n_children::BIGINT AS n_children, u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN u ON u.node = f.node LEFT JOIN f p ON p.node = f.parent
"""

OP13 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w, row_number() OVER () AS r,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL
    AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.w, b.w)::BIGINT AS score
  FROM v a JOIN v b ON b.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.r = p.r AND NOT s.same
  WHERE p.k <= 5 AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT * FROM n WHERE rank <= 3
"""

ORACLE: dict[str, str] = {
    "op1_warc": OP1, "op3_exact_top_k": OP3, "op5_mixing": OP5, "op7_lm_scoring": OP7,
    "op11_prefix_trie": OP11, "op13_hard_negatives": OP13,
}
