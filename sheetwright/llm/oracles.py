"""DuckDB SQL of the operators over documents that SQL can express."""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (k) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b, c = x.n AND c = y.n AS same FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b, same FROM l UNION ALL SELECT b, a, same FROM l),
r AS (SELECT doc_id AS doc, doc_id AS seen FROM d UNION SELECT r.doc, e.b FROM r JOIN e ON r.seen = e.a),
c AS (SELECT doc, min(seen) AS component_id FROM r GROUP BY 1),
m AS (SELECT a, count(*) AS m FROM e WHERE same GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, (1 + coalesce(m.m, 0))::BIGINT AS n_copies
FROM d JOIN c ON d.doc_id = c.doc LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.a
"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT k, min(doc_id) AS first FROM x GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM x JOIN f USING (k) WHERE first < doc_id),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
t AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.j) AS kept, count(*) AS n FROM u LEFT JOIN c ON u.doc_id = c.doc_id AND u.j = c.j WHERE c.j IS NULL GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(t.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
