"""Query of operator 4."""

from __future__ import annotations

from pyspark.sql import functions as F

from .decontamination import contamination
from .registry import query, table

WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
         r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

CTES = f"""
d AS (SELECT doc_id, {WORDS} AS w FROM {{documents}}),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, k, list_aggregate(w[s:s + k - 1], 'string_agg', ' ') AS g
        FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s
              FROM b WHERE len(w) > 0)),
occ AS (SELECT doc_id, s, k, list_aggregate(w[s:s + k - 1], 'string_agg', ' ') AS g
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s
              FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT DISTINCT doc_id, s, occ.k, item_id FROM occ JOIN win ON occ.k = win.k AND occ.g = win.g),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)"""

SQL = "WITH " + CTES.format(documents="documents") + """
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


@query("op4_decontamination", SQL)
def op4_decontamination(spark, sf):
    found = contamination(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "benchmark"), "item_id", "text")
    ids = F.array_join("item_ids", ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated",
    )
