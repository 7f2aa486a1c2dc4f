"""Size checks that decide between a broadcast and a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from .session import cut_lineage

MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 64 << 20
MAX_DRIVER_ROWS = 50_000
MAX_DRIVER_BYTES = 16 << 20
MAX_SPREAD_BYTES = 256 << 20


def _value_bytes(field: T.StructField):
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.NumericType):
        return F.coalesce(F.size(col), F.lit(0)) * 8 + 16
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(col))), F.lit(0)) + 16
    return F.lit(16)


def measure(df: DataFrame) -> tuple[int, int]:
    """(rows, approximate bytes) by one distributed aggregate."""
    width = sum((_value_bytes(f) for f in df.schema.fields), F.lit(0)).cast("bigint")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def broadcast_if_small(
    df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """Broadcast hint when the measured side fits; otherwise no hint, so the join
    shuffles both sides and adaptive execution splits skewed keys."""
    rows, size = measure(df)
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def local_if_small(df: DataFrame, max_rows: int = MAX_DRIVER_ROWS) -> DataFrame:
    """Small per-group figures computed once and reused as a local table.

    Rows and bytes are counted first; a larger result stays distributed and unhinted.
    """
    stored = cut_lineage(df, "figures")
    n, size = measure(stored)
    if n > max_rows or size > MAX_DRIVER_BYTES:
        return stored
    rows = stored.collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def spread(df: DataFrame, max_bytes: int = MAX_SPREAD_BYTES) -> DataFrame:
    """Rows over all cores ahead of heavy per-row work, for a small table in few files.

    A scan cuts files at ``spark.sql.files.maxPartitionBytes``, so a table that is larger than
    that for each core has tasks enough however few its files are, and is left as it is, as is any
    table above ``max_bytes``. Sizes are those of the files, read without their contents.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not 0 < len(files) < cores:
        return df
    found = spark.read.format("binaryFile").load(files).agg(F.sum("length").alias("n")).first()["n"] or 0
    return df.repartition(cores) if found <= max_bytes else df
