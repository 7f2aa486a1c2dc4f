"""Operator 6: rendezvous hashing of stable record keys over weighted shards.

Each (key, shard) pair has a hash u in (0, 1); a record goes to the shard with the largest
``-weight / ln(u)``. Key and shard decide alone, so a new shard takes rows only into itself and a
removed shard gives away only its own.

Defined cases: a null key is hashed as the empty string; a null text has 0 bytes (size 1, checksum
0); repeated keys go to one shard and take slots in the order of their checksum and size; an empty
table gives an empty result; other input columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

HASH_DIGITS = 13  # hexadecimal digits of md5: 52 bits, exact in a double
HASH_SPACE = 16**HASH_DIGITS
ROWS_PER_SLOT_GROUP = 50_000


def _digits(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_DIGITS), 16, 10).cast("bigint")


def _key(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def shard_of(key: Column, weights: list[float]) -> Column:
    """Shard number of a record key; ``weights[i]`` is the weight of shard i."""
    if not weights or any(not w > 0 or math.isinf(w) for w in weights):
        raise ValueError("every shard needs a positive finite weight")
    scores = [
        F.struct(
            (-F.lit(float(w)) / F.ln((_digits(F.concat(_key(key), F.lit(f":{i}"))) + F.lit(0.5)) / F.lit(float(HASH_SPACE)))).alias("score"),
            F.lit(-i).alias("first"),
        )
        for i, w in enumerate(weights)
    ]
    return (-F.array_max(F.array(*scores))["first"]).cast("int")


def assign_shards(
    df: DataFrame, key: str, text: str, weights: list[float], grown_weight: float = 1.0,
    rows_per_group: int = ROWS_PER_SLOT_GROUP,
) -> DataFrame:
    """key, size, text_crc32, shard, slot and grown_shard (the shard if one more is added).

    Slots run from 0 without gaps in each shard, in the order of the key's hash. They come from
    row numbers inside (shard, hash range) groups of about ``rows_per_group`` rows plus the row
    count of the ranges before, so no shard is ever ordered in one task.
    """
    rows = df.select(
        F.col(key).alias(key),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        _digits(_key(F.col(key))).alias("_place"),
        shard_of(F.col(key), weights).alias("shard"),
        shard_of(F.col(key), [*weights, grown_weight]).alias("grown_shard"),
    )
    total = df.select(F.lit(1)).count()
    groups = max(1, math.ceil(total / len(weights) / rows_per_group))
    rows = rows.withColumn("_range", F.floor(F.col("_place") / F.lit(float(HASH_SPACE)) * groups).cast("int"))
    counts = rows.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("shard", "_range").orderBy("_place", key, "text_crc32", "size")
    return (
        rows.withColumn("_row", F.row_number().over(order) - 1)
        .join(offsets, ["shard", "_range"])
        .select(
            key, "size", "text_crc32", "shard", (F.col("_before") + F.col("_row")).cast("bigint").alias("slot"),
            "grown_shard",
        )
    )
