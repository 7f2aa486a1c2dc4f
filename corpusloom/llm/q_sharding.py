"""Query of operator 6."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query, table
from .sharding import assign_shards

SHARDS = 16

# DuckDB has no crc32: the byte table of the polynomial, then one step per byte of the text.
SQL = """
WITH crc_table AS (
    SELECT list_transform(range(256), lambda n: list_reduce(range(8),
        lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
bytes AS (
    SELECT doc_id, text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
        lambda x: CAST('0x' || x AS BIGINT)) AS b
    FROM documents),
crc AS (
    SELECT doc_id, text, xor(4294967295, list_reduce(b,
        lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), CAST(4294967295 AS BIGINT))) AS text_crc32
    FROM bytes, crc_table),
h AS (
    SELECT doc_id, text, s, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || s), 1, 13) AS BIGINT) AS u,
           CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS place
    FROM documents, range(17) r(s)),
won AS (
    SELECT doc_id, any_value(place) AS place, CAST(arg_max(s, u) FILTER (WHERE s < 16) AS INT) AS shard,
           CAST(arg_max(s, u) AS INT) AS grown_shard
    FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(strlen(coalesce(d.text, '')) + 1 AS BIGINT) AS size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY place, d.doc_id) - 1 AS slot, grown_shard
FROM crc d JOIN won ON d.doc_id = won.doc_id
"""


@query("op6_rendezvous_sharding", SQL)
def op6_rendezvous_sharding(spark, sf):
    rows = assign_shards(table(spark, sf, "documents"), "doc_id", "text", [1.0] * SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
