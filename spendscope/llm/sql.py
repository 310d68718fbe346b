"""DuckDB SQL for the deduplication queries."""

WORDS = r"""SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents"""
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS ({WORDS.replace("coalesce(text, '')", f"coalesce({LOWER}, '')")}),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle
  FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

REPEATED_WINDOWS = f"""
WITH w AS ({WORDS}),
p AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, words FROM w),
h AS (SELECT doc_id, i, words[i] AS word, CASE WHEN i + 34 <= len(words) THEN array_to_string(words[i:i + 34], ' ') END AS win FROM p),
t AS (SELECT win FROM h WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
f AS (
  SELECT doc_id, i, word, CAST(coalesce(max(CASE WHEN t.win IS NOT NULL THEN i END)
    OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) > i - 35, FALSE) AS INTEGER) AS gone
  FROM h LEFT JOIN t USING (win)
),
k AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM f GROUP BY doc_id),
g AS (SELECT doc_id, i, gone, gone - lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM f),
b AS (
  SELECT doc_id, list(i - 1 ORDER BY i) AS edges FROM (
    SELECT doc_id, i FROM g WHERE step <> 0 UNION ALL SELECT doc_id, max(i) + 1 FROM g GROUP BY doc_id HAVING arg_max(gone, i) = 1)
  GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256, CAST(coalesce(edges, []) AS INTEGER[]) AS intervals
FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN b USING (doc_id)
"""
