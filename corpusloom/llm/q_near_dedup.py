"""Query of operator 3."""

from __future__ import annotations

from .near_dedup import near_duplicates
from .registry import query, table

SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
              lambda s: list_aggregate(w[s:s + 4], 'string_agg', ' '))) AS s FROM d WHERE len(w) > 0),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sh),
link AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
    SELECT DISTINCT a AS id, a AS r FROM link
    UNION
    SELECT reach.id, link.b FROM reach JOIN link ON reach.r = link.a),
part AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, CAST(coalesce(len(s), 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(component_id, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(component_id, d.doc_id)) AS kept
FROM d LEFT JOIN sh ON d.doc_id = sh.doc_id LEFT JOIN part ON d.doc_id = part.id
"""


@query("op3_minhash_near_dedup", SQL)
def op3_minhash_near_dedup(spark, sf):
    return near_duplicates(table(spark, sf, "documents"), "doc_id", "text", percent=85)
