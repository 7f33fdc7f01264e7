"""DuckDB SQL of the operators that SQL can express on whole tables."""

MULTI_INDEX_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0 AND NOT isnan(x)) AS bits FROM embeddings),
d AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
         len(list_filter(range(1, 65), lambda i: q.bits[i] <> v.bits[i]))::INT AS distance
  FROM v AS q, v WHERE q.vec_id % 100 = 0
),
r AS (SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, rank::INT AS rank, vec_id, distance FROM r WHERE rank <= 10
"""

LINE_DEDUP = """
WITH doc AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, i, ls[i] AS line,
         list_filter(regexp_split_to_array(ls[i], '[\\t-\\r ]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM doc)
),
f AS (SELECT w, len(w) AS n, min((doc_id * 1000000 + i)::BIGINT) AS place FROM l WHERE len(w) > 0 GROUP BY w),
k AS (
  SELECT place, n, w, 'first' AS side, w[1:4] AS part FROM f WHERE n >= 10
  UNION ALL SELECT place, n, w, 'last', w[n - 3:n] FROM f WHERE n >= 10
  UNION ALL SELECT place, n, w, 'first', w[1:2] FROM f WHERE n BETWEEN 5 AND 10
  UNION ALL SELECT place, n, w, 'last', w[n - 1:n] FROM f WHERE n BETWEEN 5 AND 10
),
pairs AS (
  SELECT DISTINCT b.place, a.place AS before FROM k AS a JOIN k AS b ON a.side = b.side AND a.part = b.part AND a.place < b.place
  WHERE abs(a.n - b.n) <= 1
),
near AS (
  SELECT DISTINCT p.place
  FROM pairs AS p JOIN f AS a ON a.place = p.before JOIN f AS b ON b.place = p.place
  WHERE CASE WHEN a.n = b.n THEN len(list_filter(range(1, a.n + 1), lambda i: a.w[i] <> b.w[i])) = 1
             WHEN a.n < b.n THEN len(list_filter(range(1, b.n + 1), lambda i: list_concat(b.w[1:i - 1], b.w[i + 1:b.n]) = a.w)) > 0
             ELSE len(list_filter(range(1, a.n + 1), lambda i: list_concat(a.w[1:i - 1], a.w[i + 1:a.n]) = b.w)) > 0 END
),
kept AS (
  SELECT l.doc_id, l.i, l.line, len(l.w) = 0 OR (f.place = l.doc_id * 1000000 + l.i AND near.place IS NULL) AS stays
  FROM l LEFT JOIN f ON f.w = l.w LEFT JOIN near ON near.place = f.place
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '') AS text,
       count(*) FILTER (WHERE NOT stays) AS dropped_lines
FROM kept GROUP BY doc_id
"""

CROSS_POLYTOPE = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n AS a JOIN n AS b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.95
),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
cnt AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT t.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, t.vec_id) AS component_id,
       t.vec_id = coalesce(component_id, t.vec_id) AS kept
FROM embeddings AS t LEFT JOIN low ON low.a = t.vec_id LEFT JOIN cnt ON cnt.a = t.vec_id
"""

ORACLES: dict[str, str] = {"op2_multi_index_topk": MULTI_INDEX_TOPK, "op5_line_dedup": LINE_DEDUP, "op10_cross_polytope": CROSS_POLYTOPE}
