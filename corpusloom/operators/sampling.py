"""Seeded samples, splits, quotas and dense ids.

A sample takes the rows with the smallest ``md5(seed|id)``: exact in size, repeatable on any
partitioning. Small quotas per group are filled in one pass: every task keeps its best rows of each
group, and only those move. Larger samples are found by thresholds, not by sorting rows: counts per
hash prefix give the prefix where the quota fills up, the rows of that one prefix give the exact last
hash, and the wide rows are then filtered in place. Only ids, groups and hashes are ever shuffled
then, however many rows one group holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from ..sizing import broadcast_if_small, local_if_small

SEED = 42
PREFIX_DIGITS = 4
SMALL_QUOTA = 10_000  # rows per group up to which a sample is taken in one pass


def seeded_hash(id_col: str | Column, seed: int = SEED) -> Column:
    """Sample order; the same hex digits any SQL engine gives."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat_ws("|", F.lit(str(seed)), c.cast("string")).cast("binary"))


def _same_group(left: DataFrame, right: DataFrame, by: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in by:
        cond = cond & left[c].eqNullSafe(right[f"_g_{c}"])
    return cond


def _cut_points(df: DataFrame, by: Sequence[str], id_col: str, seed: int, quota) -> DataFrame:
    """Per group: the hash and id of the last row inside the quota.

    One row per group; marked for broadcast when the groups were counted to be few.
    """
    narrow = df.select(
        *[F.col(c).alias(f"_g_{c}") for c in by],
        F.col(id_col).alias("_id"),
        seeded_hash(id_col, seed).alias("_h"),
    ).withColumn("_prefix", F.substring("_h", 1, PREFIX_DIGITS))
    groups = [f"_g_{c}" for c in by]
    running = Window.partitionBy(*groups).orderBy("_prefix")
    cells = (
        narrow.groupBy(*groups, "_prefix")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(running.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*groups)))
        .withColumn("_quota", F.least(quota(F.col("_total")).cast("bigint"), F.col("_total")))
        .filter((F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_n") < F.col("_quota")))
        .select(*groups, "_prefix", (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_need"))
    )
    few = not by
    if by:
        local = local_if_small(cells)
        few, cells = local is not cells, local
        match = F.lit(True)
        for g in groups:
            match = match & F.col(f"n.{g}").eqNullSafe(F.col(f"c.{g}"))
        match = match & (F.col("n._prefix") == F.col("c._prefix"))
        last = narrow.alias("n").join(cells.alias("c"), match, "inner")
    else:
        last = narrow.alias("n").join(
            F.broadcast(cells.alias("c")), F.col("n._prefix") == F.col("c._prefix"), "inner"
        )
    last = last.select(*[F.col(f"n.{g}") for g in groups], "n._id", "n._h", "c._need")
    ranked = last.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*groups).orderBy("_h", "_id"))
    )
    cuts = ranked.filter("_rank = _need").select(
        *groups, F.col("_h").alias("_cut_h"), F.col("_id").alias("_cut_id")
    )
    return F.broadcast(cuts) if few else cuts


def _take_lowest(
    df: DataFrame, by: Sequence[str], id_col: str, seed: int, quota: Callable[[Column], Column],
    inside: str | None = None,
) -> DataFrame:
    cuts = _cut_points(df, by, id_col, seed, quota)
    h = seeded_hash(id_col, seed)
    if by:
        joined = df.join(cuts, _same_group(df, cuts, by), "inner" if inside is None else "left")
    elif inside is None:
        joined = df.crossJoin(cuts)
    else:
        joined = df.join(cuts, F.lit(True), "left")
    fits = (h < F.col("_cut_h")) | ((h == F.col("_cut_h")) & (F.col(id_col) <= F.col("_cut_id")))
    extra = [f"_g_{c}" for c in by] + ["_cut_h", "_cut_id"]
    if inside is None:
        return joined.filter(fits).drop(*extra)
    return joined.withColumn(inside, F.coalesce(fits, F.lit(False))).drop(*extra)


def sample_per_group(df: DataFrame, by: Sequence[str], n: int, id_col: str, seed: int = SEED) -> DataFrame:
    """min(n, size) rows of every group; a NULL key is a group."""
    if n > SMALL_QUOTA:
        return _take_lowest(df, list(by), id_col, seed, lambda total: F.lit(n))
    return _best_rows(df, list(by), n, id_col, seed)


def _best_rows(df: DataFrame, by: list[str], n: int, id_col: str, seed: int) -> DataFrame:
    """The n first rows of every group in sample order, by one scan.

    A rank limit goes ahead of each exchange, so a task sends at most n rows of a group. Tasks are
    merged in bands first, so the last merge of a group gets n rows from each band and not from each
    task, whatever share of the rows the group has.
    """
    bands = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1024)
    order = [F.col("_sample_h"), F.col(id_col)]
    ranked = df.withColumns({"_sample_h": seeded_hash(id_col, seed), "_sample_band": F.spark_partition_id() % bands})
    for keys in ([*by, "_sample_band"], by):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        ranked = ranked.withColumn("_sample_rank", place).filter(F.col("_sample_rank") <= n)
    return ranked.drop("_sample_h", "_sample_band", "_sample_rank")


def sample_n(df: DataFrame, n: int, id_col: str, seed: int = SEED) -> DataFrame:
    """n rows, or all of them when n is 0 or not below the size."""
    return df if n == 0 else _take_lowest(df, [], id_col, seed, lambda total: F.lit(n))


def sample_order(by: Sequence[str], id_col: str, seed: int = SEED):
    """Window in sample order inside a group."""
    return Window.partitionBy(*by).orderBy(seeded_hash(id_col, seed), F.col(id_col))


def stratified(df: DataFrame, by: str, n: int, id_col: str, strata: Sequence[str], seed: int = SEED) -> DataFrame:
    """up to n rows per stratum, stacked in the given order, with ``temp_id`` from 0."""
    picked = sample_per_group(df.filter(F.col(by).isin(list(strata))), [by], n, id_col, seed)
    place = F.array_position(F.array(*[F.lit(s) for s in strata]), F.col(by))
    order = [place, seeded_hash(id_col, seed), F.col(id_col)]
    if n <= SMALL_QUOTA:  # at most n rows of each stratum that is named here: one task numbers them
        return picked.withColumn("temp_id", (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint"))
    return dense_id(picked, order, name="temp_id")


def split_flag(id_col: str, test: float = 0.1, seed: int = SEED) -> Column:
    """stateless test flag from the first 32 bits of the hash; also fits a stream."""
    bound = f"{math.ceil(test * (1 << 32)):08x}"
    return F.substring(seeded_hash(id_col, seed), 1, 8) < bound


def split_exact(df: DataFrame, id_col: str, test: float = 0.1, seed: int = SEED) -> DataFrame:
    """F7, exact: ``is_test`` on ceil(test * n) rows, set in place by the cut point."""
    return _take_lowest(
        df, [], id_col, seed, lambda total: F.ceil(F.lit(test) * total), inside="is_test"
    )


def head(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """F8: the first n rows of a stated order (top-n per task, then merged)."""
    return df.orderBy(*order).limit(n)


def cap_per_key(
    df: DataFrame, key: str, order: Sequence[str], n: int, salts: int | None = None
) -> DataFrame:
    """At most n rows per key, in order; rows equal in ``order`` fill the quota in any order.

    Only the narrow (key, order) columns are ranked, first inside (key, salt) so that a hot key is
    spread over many tasks, then over the at most n x salts survivors of a key. That gives the last
    place inside each full quota; wide rows beyond it are dropped where they are read, and only
    those of the result, and ties at its end, are shuffled.
    """
    spark = df.sparkSession
    if salts is None:
        salts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1024)
    place = F.struct(*order)
    local = Window.partitionBy("_key", "_salt").orderBy("_place")
    overall = Window.partitionBy("_key").orderBy("_place")
    last = (
        df.select(F.col(key).alias("_key"), place.alias("_place"), F.pmod(F.xxhash64(*order), F.lit(salts)).alias("_salt"))
        .withColumn("_rank", F.row_number().over(local))
        .filter(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(overall))
        .filter(F.col("_rank") == n)
        .select("_key", F.col("_place").alias("_last"))
    )
    last = broadcast_if_small(cut_lineage(last, "quota"))
    inside = df.join(last, F.col(key).eqNullSafe(F.col("_key")), "left").filter(F.col("_last").isNull() | (place <= F.col("_last")))
    return (
        inside.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
        .filter(F.col("_rank") <= n)
        .drop("_key", "_last", "_rank")
    )


def dense_id(
    df: DataFrame, order: Sequence[str | Column], start: int = 0, name: str = "row_id"
) -> DataFrame:
    """C17: BIGINT ids without gaps, in order.

    Rows are range-partitioned, written once to the checkpoint folder and numbered inside each
    range, shifted by the sizes of the ranges before. It goes the same way at every size.
    """
    keyed = df.select("*", *[
        (c if isinstance(c, Column) else F.col(c)).alias(f"_o{i}") for i, c in enumerate(order)
    ])
    keys = [f"_o{i}" for i in range(len(order))]
    ranges = cut_lineage(
        keyed.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id())
    )
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    shift = F.coalesce(
        F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    offsets = sizes.select("_range", shift.alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    return (
        ranges.join(broadcast_if_small(offsets), "_range")
        .withColumn(name, (F.col("_before") + rank - 1 + start).cast("bigint"))
        .drop("_range", "_before", *keys)
    )
