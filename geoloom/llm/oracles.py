"""SQL (DuckDB) with the same rows as the queries that SQL can express."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT d.doc_id, count(s.g) AS n_shingles FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT p.x, p.y FROM p JOIN n a ON a.doc_id = p.x JOIN n b ON b.doc_id = p.y
  WHERE 100 * p.c >= 80 * (a.n_shingles + b.n_shingles - p.c)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM d
  UNION
  SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
), m AS (
  SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x
)
SELECT n.doc_id, CAST(n.n_shingles AS BIGINT) AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept
FROM n JOIN m ON n.doc_id = m.doc_id
"""

CONTAMINATION = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), l AS (
  SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d CROSS JOIN l WHERE len(w) >= n)
), h AS (
  SELECT DISTINCT dw.doc_id, dw.p, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), c AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= coalesce(len(d.w), 0) AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""

LEXICAL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark
), bt AS (
  SELECT DISTINCT item, item_id, unnest(w) AS t FROM b
), c AS (
  SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0
), tf AS (
  SELECT uid, doc_id, n, t, count(*) AS tf FROM (SELECT uid, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM d)
  WHERE t IN (SELECT t FROM bt) GROUP BY uid, doc_id, n, t
), wt AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf CROSS JOIN c GROUP BY t, n_docs
), s AS (
  SELECT item, item_id, uid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM bt JOIN tf ON tf.t = bt.t JOIN wt ON wt.t = bt.t CROSS JOIN c GROUP BY item, item_id, uid, doc_id
), r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

PREFERENCES = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT (conv_id - ((conv_id % 2 + 2) % 2)) // 2 AS pair_id, min(conv_id) AS chosen_id, max(conv_id) AS rejected_id
  FROM (SELECT DISTINCT conv_id FROM t) GROUP BY 1 HAVING min(conv_id) < max(conv_id)
), n AS (
  SELECT conv_id, max(k) AS n FROM t GROUP BY conv_id
), d AS (
  SELECT p.pair_id, min(c.k) - 1 AS k FROM p JOIN t c ON c.conv_id = p.chosen_id
  JOIN t r ON r.conv_id = p.rejected_id AND r.k = c.k WHERE c.role <> r.role OR c.text <> r.text GROUP BY p.pair_id
), q AS (
  SELECT p.*, coalesce(d.k, least(a.n, b.n)) AS m FROM p JOIN n a ON a.conv_id = p.chosen_id
  JOIN n b ON b.conv_id = p.rejected_id LEFT JOIN d ON d.pair_id = p.pair_id
), s AS (
  SELECT q.pair_id, t.conv_id = q.chosen_id AS chosen, t.k <= q.m AS prompt, t.k, t.role,
         '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10) AS x, length(t.text) + 8 AS loss
  FROM q JOIN t ON t.conv_id = q.chosen_id OR t.conv_id = q.rejected_id
), g AS (
  SELECT pair_id,
    string_agg(x, '' ORDER BY k) FILTER (WHERE prompt AND chosen) AS prompt,
    string_agg(x, '' ORDER BY k) FILTER (WHERE NOT prompt AND chosen) AS chosen,
    string_agg(x, '' ORDER BY k) FILTER (WHERE NOT prompt AND NOT chosen) AS rejected,
    coalesce(sum(loss) FILTER (WHERE NOT prompt AND chosen AND role = 'assistant'), 0) AS chosen_loss_chars,
    coalesce(sum(loss) FILTER (WHERE NOT prompt AND NOT chosen AND role = 'assistant'), 0) AS rejected_loss_chars
  FROM s GROUP BY pair_id
)
SELECT q.pair_id, q.chosen_id, q.rejected_id, CAST(q.m AS BIGINT) AS prompt_turns,
  sha256(coalesce(g.prompt, '')) AS prompt_sha256, sha256(coalesce(g.chosen, '')) AS chosen_sha256,
  sha256(coalesce(g.rejected, '')) AS rejected_sha256,
  CAST(chosen_loss_chars AS BIGINT) AS chosen_loss_chars, CAST(rejected_loss_chars AS BIGINT) AS rejected_loss_chars
FROM q JOIN g ON g.pair_id = q.pair_id
"""
