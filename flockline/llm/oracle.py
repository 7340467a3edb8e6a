"""SQL (DuckDB) for the queries that it can express on whole tables, by definition and not by method."""

from __future__ import annotations

import string

from . import mixing

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

NEAREST = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS sh
    FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS least FROM r GROUP BY a) m ON m.a = d.doc_id
"""


# Units of every document, windows by the first document that they start in, and what they cover.  The same over
# bytes takes minutes on a few hundred KB, so op4_suffix_dedup is held against a brute-force version instead.
PHRASE = f"""
WITH u AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS u FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(u) - 48)) AS i, u FROM u WHERE len(u) >= 50),
x AS (SELECT doc_id, i, md5(array_to_string(u[i:i + 49], ' ')) AS win FROM p),
f AS (SELECT win, min(doc_id) AS first FROM x GROUP BY win),
h AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM x JOIN f USING (win) WHERE first < doc_id),
hs AS (SELECT doc_id, min(i) AS s, max(i) + 49 AS e FROM h GROUP BY doc_id, g),
mk AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM hs),
gr AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM mk),
sp AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM gr GROUP BY doc_id, k),
z AS (SELECT doc_id, list({{'s': s, 'e': e}} ORDER BY s) AS sp, sum(e - s + 1) AS removed FROM sp GROUP BY doc_id),
y AS (SELECT u.doc_id, u, coalesce(sp, []) AS sp, coalesce(removed, 0) AS removed FROM u LEFT JOIN z USING (doc_id)),
k AS (SELECT *, list_transform(range(0, len(sp) + 1), lambda j: u[(CASE WHEN j = 0 THEN 1 ELSE sp[j].e + 1 END):(CASE WHEN j = len(sp) THEN len(u) ELSE sp[j + 1].s - 1 END)]) AS kept FROM y)
SELECT doc_id, len(u)::BIGINT AS n_words, removed::BIGINT AS n_removed, sha256(array_to_string(flatten(kept), ' ')) AS kept_sha256 FROM k
"""

DECONTAM = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOWER}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
ia AS (SELECT *, CASE WHEN len(w) < 10 THEN len(w) ELSE least(greatest(5, (2 * len(w) + 2) // 3), len(w) - 5) END AS cut FROM iw WHERE len(w) > 0),
ih AS (SELECT item_id, 'q' AS half, w[1:cut] AS w FROM ia UNION ALL SELECT item_id, 'a', CASE WHEN len(w) < 10 THEN w ELSE w[cut + 1:] END FROM ia),
ig AS (SELECT DISTINCT item_id, half, size, gram FROM (SELECT item_id, half, least(5, len(w)) AS size, unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' '))) AS gram FROM ih)),
n AS (SELECT item_id, half, count(*) AS n FROM ig GROUP BY ALL),
dg AS (SELECT DISTINCT doc_id, size, gram FROM (SELECT doc_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS gram FROM dw, (SELECT DISTINCT size FROM ig) WHERE len(w) >= size)),
c AS (SELECT doc_id, item_id, half, count(*) / any_value(n.n)::DOUBLE AS share FROM dg JOIN ig USING (size, gram) JOIN n USING (item_id, half) GROUP BY ALL),
s AS (SELECT doc_id, item_id, max(share) FILTER (half = 'q') AS question_share, max(share) FILTER (half = 'a') AS answer_share FROM c GROUP BY ALL)
SELECT * FROM s WHERE question_share >= 0.6 AND answer_share >= 0.6
"""

SQL = {"op1_nearest": NEAREST, "op3_jaccard_join": JACCARD, "op5_mixing": mixing.SQL, "op8_phrase_dedup": PHRASE, "op10_decontamination": DECONTAM}
