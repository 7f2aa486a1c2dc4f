"""Duplicate removal (F1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def dedup_first(df: DataFrame, keys: Sequence[str], order: str | Column, text_col: str | None = None) -> DataFrame:
    """the first row of every key.

    ``rank = 1`` is planned as a group limit before the shuffle, so each task sends one row
    per key and a hot group of copies never meets in one task. With ``text_col`` the sort
    compares a 64-bit hash first and reads the long text only where hashes agree.
    """
    cols = [F.col(k) for k in keys]
    if text_col:
        cols = [F.col(k) for k in keys if k != text_col]
        cols += [F.xxhash64(text_col), F.col(text_col)]
    w = Window.partitionBy(*cols).orderBy(order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")
