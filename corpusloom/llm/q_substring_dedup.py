"""Query of operator 7."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query, table
from .substring_dedup import remove_repeats

SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, list_aggregate(w[s:s + 34], 'string_agg', ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
again AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT doc_id, list_distinct(list(p)) AS p
         FROM (SELECT doc_id, unnest(range(s, s + 35)) AS p FROM win JOIN again ON win.g = again.g) GROUP BY doc_id),
place AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT place.doc_id, string_agg(w[p], ' ' ORDER BY p) AS t
         FROM place WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(p) AS q FROM gone) x
                                      WHERE x.doc_id = place.doc_id AND x.q = place.p) GROUP BY place.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone.p), 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


@query("op7_substring_dedup", SQL)
def op7_substring_dedup(spark, sf):
    kept = remove_repeats(table(spark, sf, "documents"), "doc_id", "text")
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
