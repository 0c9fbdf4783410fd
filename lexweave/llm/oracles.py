"""SQL for the operators that it can express, by the plain definition of their results."""

from __future__ import annotations

from . import license_scan, mixing

JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 3 THEN list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' ')) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 90 * (a.n + b.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.y FROM reach r JOIN links l ON l.x = r.b)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, min(b) AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN reach ON a = w.doc_id GROUP BY w.doc_id, n
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.oracle(), "op2_jaccard_join": JACCARD, "op3_mix_sources": mixing.SQL}
