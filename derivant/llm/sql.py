"""The rows of further queries in DuckDB, by plain comparison of everything with everything."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k : k + least(len(ws), 3) - 1], ' ') AS g, least(len(ws), 3) AS width FROM w, unnest(range(1, len(ws) - least(len(ws), 3) + 2)) AS u(k) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.width = b.width AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id)
"""

EMBED_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE e IS NOT NULL AND NOT list_contains(list_transform(e, lambda x: coalesce(isfinite(x), false)), false) AND list_inner_product(e, e) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c USING (vec_id)
"""

SUBSTRING_DEDUP = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, k, array_to_string(ws[k : k + 12], ' ') AS g FROM w, unnest(range(1, len(ws) - 11)) AS u(k) WHERE len(ws) >= 13),
f AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
hit AS (SELECT DISTINCT doc_id, k + j AS pos FROM win JOIN f USING (g), unnest(range(0, 13)) AS u(j) WHERE first < doc_id),
word AS (SELECT doc_id, pos, ws[pos] AS x FROM w, unnest(range(1, len(ws) + 1)) AS u(pos)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY pos) AS t FROM word ANTI JOIN hit USING (doc_id, pos) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(gone.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
