"""SQL of the queries that SQL can express."""

from __future__ import annotations

NEAR_DUPLICATES = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT r, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') || ' ' || len(w) ELSE array_to_string(w[i : i + 4], ' ') || ' 5' END AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
rare AS (SELECT s FROM sh GROUP BY s HAVING count(*) > 1),
shared AS (SELECT r, s FROM sh JOIN rare USING (s)),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM shared a JOIN shared b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON a = x.r JOIN sizes y ON b = y.r WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS r, a AS m FROM both_ways UNION SELECT e.b, reach.m FROM reach JOIN both_ways e ON e.a = reach.r WHERE e.b > reach.m)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce((SELECT c.doc_id FROM docs c WHERE c.r = least(d.r, coalesce(l.m, d.r))), d.doc_id) AS component_id FROM docs d LEFT JOIN sizes USING (r) LEFT JOIN (SELECT r, min(m) AS m FROM reach GROUP BY r) l ON l.r = d.r
"""

DECONTAMINATE = r"""
WITH folded AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM folded),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
met AS (SELECT r, p.n, i, item FROM places p JOIN windows v ON p.n = v.n AND p.k = v.k),
hits AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, n, i FROM met)) GROUP BY r),
listed AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM met) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN listed USING (r)
"""

ORACLES = {"op4_near_duplicates": NEAR_DUPLICATES, "op10_decontaminate": DECONTAMINATE}
