"""Query of operator 13."""

from __future__ import annotations

from .registry import query, table
from .spelling import spelling_variants

# DuckDB has no crc32: the byte table of the polynomial, then one step per byte.
SQL = r"""
WITH RECURSIVE crc_table AS (
    SELECT list_transform(range(256), lambda n: list_reduce(range(8),
        lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[a-zÀ-ÿ]+')) AS run FROM documents),
met AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
h AS (
    SELECT run, n, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), '..'),
        lambda x: CAST('0x' || x AS BIGINT)), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), CAST(4294967295 AS BIGINT))) AS h
    FROM met, crc_table),
made AS (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
skip AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) AS pre, substr(word, i + 1) AS suf FROM w, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
near AS (
    SELECT a.word AS a, b.word AS b FROM skip a JOIN skip b ON a.i = b.i AND a.pre = b.pre AND a.suf = b.suf AND a.word <> b.word
    UNION SELECT w.word, s.word FROM w JOIN skip s ON w.word = s.pre || s.suf
    UNION SELECT s.word, w.word FROM w JOIN skip s ON w.word = s.pre || s.suf),
best AS MATERIALIZED (
    SELECT a AS word, count(*) OVER (PARTITION BY a) AS n_near, b, w.n AS b_n
    FROM near JOIN w ON near.b = w.word QUALIFY row_number() OVER (PARTITION BY a ORDER BY w.n DESC, b) = 1),
f AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b_n >= 2 * w.n THEN b END AS form, CASE WHEN b_n >= 2 * w.n THEN b_n END AS form_n
    FROM w LEFT JOIN best ON w.word = best.word),
up AS (
    SELECT word, word AS root FROM f
    UNION ALL SELECT up.word, f.form FROM up JOIN f ON up.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT up.word, up.root FROM up JOIN f ON up.root = f.word WHERE f.form IS NULL)
SELECT f.word, f.n, CAST(n_near AS BIGINT) AS n_near, form, form_n, root FROM f JOIN ends ON f.word = ends.word
"""


@query("op13_spelling_variants", SQL)
def op13_spelling_variants(spark, sf):
    return spelling_variants(table(spark, sf, "documents"), "doc_id", "text")
