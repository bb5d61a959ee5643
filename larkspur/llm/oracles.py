"""DuckDB SQL for the numbered operators whose results SQL can express."""

from __future__ import annotations

from larkspur.llm import mixing

LINES = r"""
WITH RECURSIVE
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents WHERE text IS NOT NULL),
d AS (SELECT DISTINCT line, length(line) AS n FROM l WHERE length(line) >= 32),
-- each line among those of its own length and of the length one below, by both halves
s AS (SELECT line, n, n - role AS m, role FROM d, (VALUES (0), (1)) AS r(role) WHERE n - role >= 32),
h AS (SELECT line, n, m, role, 'start' AS side, left(line, (m // 2)::INT) AS half FROM s
      UNION ALL SELECT line, n, m, role, 'end', right(line, (m - m // 2)::INT) FROM s),
c AS (SELECT DISTINCT a.line AS x, b.line AS y, a.n AS n, b.role AS longer
      FROM h a JOIN h b ON a.m = b.m AND a.side = b.side AND a.half = b.half AND a.role = 0 AND a.line <> b.line),
e AS (SELECT x, y FROM c WHERE CASE WHEN longer = 0
        THEN len(list_filter(range(1, n + 1), lambda i: substring(x, i, 1) <> substring(y, i, 1))) = 1
        ELSE len(list_filter(range(1, n + 2), lambda i: substring(y, 1, i - 1) || substring(y, i + 1) = x)) > 0 END),
links AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (SELECT x, y FROM links UNION SELECT r.x, k.y FROM reach r JOIN links k ON r.y = k.x),
heads AS (SELECT x AS line, least(x, min(y)) AS head FROM reach GROUP BY x),
o AS (SELECT l.*, trim(l.line) <> '' AS full_, row_number() OVER (PARTITION BY coalesce(head, l.line) ORDER BY doc_id, p) AS nth FROM l LEFT JOIN heads USING (line)),
k AS (SELECT doc_id, count(*) FILTER (WHERE full_ AND nth > 1) AS n_removed, count(*) AS n_lines,
             coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT (full_ AND nth > 1)), '') AS kept
      FROM o GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_removed, 0)::INT AS n_removed, sha256(kept) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)
"""

SUBSTRINGS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 34], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
rep AS (SELECT doc_id, i FROM win JOIN (SELECT s FROM win GROUP BY s HAVING count(*) > 1) USING (s)),
gone AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(range(i, i + 35)) AS k FROM rep)),
e AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS k FROM w),
a AS (SELECT doc_id, count(*) AS n_words, count(g.k) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY e.k) FILTER (WHERE g.k IS NULL), '') AS kept
      FROM e LEFT JOIN gone g USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN a USING (doc_id)
"""

EMBEDDINGS = r"""
WITH RECURSIVE
v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS least FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

ORACLES = {
    "op2_mix_sources": mixing.ORACLE,
    "op3_line_dedup": LINES,
    "op5_substring_dedup": SUBSTRINGS,
    "op7_embedding_near_dedup": EMBEDDINGS,
}
