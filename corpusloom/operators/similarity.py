"""Exact nearest-neighbour similarity of vectors.

Two plans, chosen by the measured size of the target side:

*Broadcast.* Targets that fit the bound go to every executor as one matrix; the query rows stay
where they are and are scored batch by batch.

*Cells.* Equal vectors are first reduced to one row with a copy count, so a hot group of copies
is a single row. Distinct targets form a tree of two levels whose size follows from their number:
each joins the cell of its nearest pivot, and inside of it the leaf of its nearest sub-pivot, of which
a cell has one for every ``block`` / 4 of its rows. Pivots are few and known everywhere; the
sub-pivots of a cell are one row of a table. A query visits its own leaf first; the k-th similarity
found there bounds how far a better neighbour can lie, and by the triangle inequality on angles
only cells, and inside of these only leaves, that reach into that distance are visited next. Leaves
that cannot help are never touched and nothing is dropped, so results equal the all-pairs answer.
Visits are counted per leaf and packed into blocks by that count, and a crowded leaf is cut into
blocks. A block pair gives at most k figures per query, never its pairs.

*Grid.* Vectors without structure leave nothing to skip. Where a probe of some queries reaches more than
``DENSE`` of the targets, large packs of queries meet large packs of targets instead, each pair of packs
once, so a vector moves once for tens of thousands of others. What a query found in its own leaf is the
floor below which nothing is kept. The work is that of all pairs; the answer is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.flags import overlap_flag
from ..session import cut_lineage
from ..sizing import broadcast_if_small
from .sampling import sample_n

BLOCK = 2048
MOST_PIVOTS = 1024  # of the first level
MOST_SUB_PIVOTS = 4096  # of one cell
FAR = 2.0  # times the middle angle of a cell's rows to their sub-pivots
PACK = 8192  # rows of a cell that meet its sub-pivots together
SLACK = 1e-6  # radians; covers rounding in the angle bounds
KNN_BROADCAST_BYTES = 8 << 20  # every Python worker holds a copy of a broadcast matrix
TILE = 1 << 20  # similarities a task holds at a time
OUT_ROWS = 1 << 16  # visits in one Arrow batch
PROBES = 128  # queries that tell how much of the targets can be skipped
DENSE = 1 / 32  # share of the targets above which the grid takes over
GRID_BYTES = 8 << 20  # vectors of one pack of the grid


# ---- arrays inside tasks -------------------------------------------------------------------

def _unit_rows(flat: np.ndarray, n: int) -> np.ndarray:
    m = np.asarray(flat, dtype=np.float64).reshape(n, -1)
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _column_matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return _unit_rows(column.flatten().to_numpy(zero_copy_only=False), len(column))


def _angles(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1.0, 1.0))


def _best(sims: np.ndarray, copies: np.ndarray, own: np.ndarray | None, k: int) -> list[np.ndarray]:
    """Per row the k largest similarities, each counted as often as it has copies.

    ``own`` marks the query's own vector, of which one copy is the query itself.
    """
    m = min(k + 1, sims.shape[1])
    at = np.argpartition(-sims, m - 1, axis=1)[:, :m]
    at = np.take_along_axis(at, np.argsort(-np.take_along_axis(sims, at, 1), axis=1), 1)
    top = np.take_along_axis(sims, at, 1)
    times = np.broadcast_to(copies, sims.shape)
    times = np.take_along_axis(times, at, 1)
    if own is not None:
        times = times - np.take_along_axis(own, at, 1)
    return [np.repeat(t, c)[:k] for t, c in zip(top, times)]


def _chunks(n: int, width: int, most: int = TILE) -> Iterator[slice]:
    step = max(1, most // max(width, 1))
    for i in range(0, n, step):
        yield slice(i, min(i + step, n))


# ---- broadcast plan ------------------------------------------------------------------------

def _target_matrix(targets: DataFrame, id_col: str, vec: str):
    table = targets.select(id_col, vec).toArrow()
    return table[id_col].to_numpy(), _column_matrix(table[vec])


def _knn_broadcast(
    queries: DataFrame, targets: DataFrame, id_col: str, target_id: str, vec: str, k: int, own: bool
) -> DataFrame:
    shared = queries.sparkSession.sparkContext.broadcast(_target_matrix(targets, target_id, vec))

    def score(batches):
        ids, matrix = shared.value
        ones = np.ones(len(ids), dtype=np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            q_ids = batch.column(0).to_numpy(zero_copy_only=False)
            q = _column_matrix(batch.column(1))
            found: list[np.ndarray] = []
            for part in _chunks(len(q_ids), len(ids)):
                mine = (q_ids[part, None] == ids[None, :]).astype(np.int64) if own else None
                found += _best(q[part] @ matrix.T, ones, mine, k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, type=pa.list_(pa.float64()))], ["_id", "_sims"]
            )

    id_type = queries.schema[id_col].dataType.simpleString()
    return queries.select(id_col, vec).mapInArrow(score, f"_id {id_type}, _sims ARRAY<DOUBLE>")


# ---- cell plan -----------------------------------------------------------------------------

def _distinct(df: DataFrame, id_col: str, vec: str, enough: int | None = None) -> DataFrame:
    """Distinct vectors with their smallest id and number of copies.

    The k nearest neighbours never need more than ``enough`` copies of one vector; without it
    the number is the full one.
    """
    copies = F.count(F.lit(1))
    return df.groupBy(F.col(vec).alias("_vec")).agg(
        F.min(id_col).alias("_rep"),
        (copies if enough is None else F.least(copies, F.lit(enough))).cast("bigint").alias("_copies"),
    )


class _Cells:
    """Distinct targets as a tree of pivots, sub-pivots and blocks."""

    def __init__(self, targets: DataFrame, pivots: int | None, block: int):
        targets = cut_lineage(targets, "distinct")
        self.block, self.leaf = block, max(block // 4, 1)
        n = self.n = targets.count()
        self.pivots = min(MOST_PIVOTS, max(1, ceil(2 * sqrt(n / self.leaf)))) if pivots is None else pivots
        picked = sample_n(targets, self.pivots, "_rep").select("_vec").toArrow()
        matrix = _column_matrix(picked["_vec"])
        self._shared = targets.sparkSession.sparkContext.broadcast(matrix)
        homed = cut_lineage(self.locate(targets), "homed")
        sizes = homed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_angle").alias("r")).collect()  # one row per pivot at most
        self.radius = np.full(len(matrix), -np.inf)
        counts = np.zeros(len(matrix), np.int64)
        for row in sizes:
            self.radius[row["_cell"]], counts[row["_cell"]] = row["r"], row["n"]
        self._packs = F.get(F.array(*[F.lit(max(int(x), 1)) for x in -(-counts // PACK)]), F.col("_cell"))
        # A cell's sub-pivots: its pivot, and a share of its rows picked by a hash.
        many = np.minimum(MOST_SUB_PIVOTS, counts // self.leaf)
        share = np.where(many > 1, np.minimum(1.0, many / np.maximum(counts, 1)), 0.0)
        cells = targets.sparkSession.createDataFrame(
            [(c, [float(x) for x in matrix[c]], float(share[c]), int(many[c])) for c in np.flatnonzero(counts).tolist()],
            "_cell INT, s_flat ARRAY<DOUBLE>, _share DOUBLE, _many INT",
        )
        self._subs = cut_lineage(self._more(cells, homed), "sub-pivots")
        # Rows far from all of these belong to groups that the share passed over; they get sub-pivots too,
        # else a few of them would widen a leaf until no bound excludes it.
        near = cut_lineage(self.settle(homed, ["_rep", "_vec"]), "settled")
        middle = near.groupBy("_cell").agg(F.percentile_approx("_angle", 0.5).alias("_mid"))
        far = cut_lineage(near.join(F.broadcast(middle), "_cell").filter(F.col("_angle") > FAR * F.col("_mid") + SLACK).select("_cell", "_rep", "_vec"), "far")
        among = far.groupBy("_cell").agg(F.count(F.lit(1)).alias("_far"))
        again = self._subs.join(F.broadcast(among), "_cell", "left").withColumn(
            "_share", F.coalesce(F.least(F.lit(1.0), F.col("_many") / F.col("_far")), F.lit(0.0))
        ).drop("_far")
        self._subs = cut_lineage(self._more(again, far).select("_cell", "s_flat"), "sub-pivots")
        self.homed = cut_lineage(self.settle(homed.drop("_angle"), ["_rep", "_copies", "_vec"]), "leaves")
        leaves = self.homed.groupBy("_cell", "_sub").agg(F.count(F.lit(1)).alias("n"), F.max("_angle").alias("r"))
        leaves = leaves.withColumn("_parts", F.ceil(F.col("n") / block).cast("int"))
        self.leaves = cut_lineage(leaves, "leaf-sizes")
        per_cell = self.leaves.groupBy("_cell").agg(F.collect_list(F.struct("_sub", "r", "_parts", "n")).alias("l"))
        self._reach = cut_lineage(self._subs.join(per_cell, "_cell").select(
            "_cell", "s_flat", F.col("l._sub").alias("l_sub"), F.col("l.r").alias("l_r"), F.col("l._parts").alias("l_parts"), F.col("l.n").alias("l_n")
        ), "reach")
        part = F.pmod(F.xxhash64("_rep"), F.col("_parts"))
        self.blocks = (
            self.homed.join(broadcast_if_small(self.leaves.select("_cell", "_sub", "_parts")), ["_cell", "_sub"])
            .groupBy("_cell", "_sub", part.alias("_part"))
            .agg(F.collect_list(F.struct("_rep", "_copies", "_vec")).alias("_rows"))
            .select(
                "_cell", "_sub", "_part", F.col("_rows._rep").alias("t_ids"), F.col("_rows._copies").alias("t_copies"),
                F.flatten("_rows._vec").alias("t_flat"),
            )
        )

    @staticmethod
    def _more(cells: DataFrame, rows: DataFrame) -> DataFrame:
        """Cells (one row per pivot at most) with a share of some of their rows added to their sub-pivots."""
        picked = F.pmod(F.xxhash64("_rep", F.lit("sub-pivot")), F.lit(1 << 30)) < F.col("_share") * (1 << 30)
        found = rows.select("_cell", "_rep", "_vec").join(F.broadcast(cells.select("_cell", "_share")), "_cell").filter(picked)
        lists = found.groupBy("_cell").agg(F.sort_array(F.collect_list(F.struct("_rep", "_vec"))).alias("s"))
        flat = F.flatten(F.transform("s", lambda x: F.transform(x["_vec"], lambda y: y.cast("double"))))
        return cells.join(lists.select("_cell", flat.alias("_s")), "_cell", "left").withColumn(
            "s_flat", F.concat("s_flat", F.coalesce("_s", F.array().cast("array<double>")))
        ).drop("_s")

    def locate(self, df: DataFrame) -> DataFrame:
        """Adds the nearest pivot and the angle to it."""
        shared = self._shared

        def nearest(batches):
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                cos = _column_matrix(batch.column("_vec")) @ shared.value.T
                cell = cos.argmax(axis=1)
                angle = _angles(cos[np.arange(len(cell)), cell])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)],
                    [*batch.schema.names, "_cell", "_angle"],
                )

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInArrow(nearest, f"{schema}, _cell INT, _angle DOUBLE")

    def _with_table(self, rows: DataFrame, columns: list[str], table: DataFrame) -> DataFrame:
        """Rows of a cell in packs, as arrays, next to the cell's row of a table."""
        packs = rows.groupBy("_cell", F.pmod(F.xxhash64("_rep"), self._packs).alias("_pack")).agg(
            F.collect_list(F.struct(*columns)).alias("_rows")
        )
        return packs.select("_cell", *[F.col(f"_rows.{c}").alias(c) for c in columns]).join(table, "_cell")

    def settle(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """Rows with ``_cell``: adds the nearest sub-pivot of the cell and the angle to it."""

        def nearest(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {name: batch.column(name)[i].values for name in columns}
                    q = _column_matrix(row["_vec"])
                    flat = batch.column("s_flat")[i].values.to_numpy(zero_copy_only=False)
                    pivots = _unit_rows(flat, len(flat) // q.shape[1])
                    sub, top = np.zeros(len(q), np.int32), np.zeros(len(q))
                    for part in _chunks(len(q), len(pivots)):
                        cos = q[part] @ pivots.T
                        sub[part], top[part] = cos.argmax(axis=1), cos.max(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [*row.values(), pa.array(np.full(len(sub), batch.column("_cell")[i].as_py(), np.int32)), pa.array(sub), pa.array(_angles(top))],
                        [*columns, "_cell", "_sub", "_angle"],
                    )

        schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
        return self._with_table(rows, columns, self._subs).mapInArrow(nearest, f"{schema}, _cell INT, _sub INT, _angle DOUBLE")

    def reachable(self, queries: DataFrame) -> DataFrame:
        """One row per query and leaf that may hold a vector within the query's ``_reach``, other than
        its own (``_cell`` and ``_sub``, already visited; -1 for none)."""
        shared, radius = self._shared, self.radius

        def cells(batches):
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                for part in _chunks(batch.num_rows, len(radius), OUT_ROWS):
                    some = batch.slice(part.start, part.stop - part.start)
                    angle = _angles(_column_matrix(some.column("_vec")) @ shared.value.T)
                    reach = some.column("_reach").to_numpy(zero_copy_only=False)
                    q, c = np.nonzero(angle - radius[None, :] <= reach[:, None] + SLACK)
                    kept = [some.column(name).take(pa.array(q)) for name in ("_rep", "_vec", "_reach", "_cell", "_sub")]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(c.astype(np.int32))], ["_rep", "_vec", "_reach", "_own", "_own_sub", "_cell"])

        columns = ["_rep", "_vec", "_reach", "_own", "_own_sub"]
        rep, vec = (queries.schema[c].dataType.simpleString() for c in ("_rep", "_vec"))
        met = queries.select("_rep", "_vec", "_reach", "_cell", "_sub").mapInArrow(
            cells, f"_rep {rep}, _vec {vec}, _reach DOUBLE, _own INT, _own_sub INT, _cell INT"
        )

        def leaves(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {name: batch.column(name)[i].values for name in columns}
                    q = _column_matrix(row["_vec"])
                    flat = batch.column("s_flat")[i].values.to_numpy(zero_copy_only=False)
                    sub, r, parts = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("l_sub", "l_r", "l_parts"))
                    pivots = _unit_rows(flat, len(flat) // q.shape[1])[sub]
                    reach, own_sub = (row[name].to_numpy(zero_copy_only=False)[:, None] for name in ("_reach", "_own_sub"))
                    cell = batch.column("_cell")[i].as_py()
                    home = row["_own"].to_numpy(zero_copy_only=False)[:, None] == cell
                    for part in _chunks(len(q), len(sub), OUT_ROWS):
                        near = _angles(q[part] @ pivots.T) - r[None, :] <= reach[part] + SLACK
                        near &= ~(home[part] & (own_sub[part] == sub[None, :]))
                        at, leaf = np.nonzero(near)
                        at += part.start
                        yield pa.RecordBatch.from_arrays(
                            [row["_rep"].take(pa.array(at)), row["_vec"].take(pa.array(at)), pa.array(np.full(len(at), cell, np.int32)),
                             pa.array(sub[leaf].astype(np.int32)), pa.array(parts[leaf].astype(np.int32))],
                            ["_rep", "_vec", "_cell", "_sub", "_parts"],
                        )

        return self._with_table(met, columns, self._reach).mapInArrow(leaves, f"_rep {rep}, _vec {vec}, _cell INT, _sub INT, _parts INT")

    def bounds(self, queries: DataFrame, k: int) -> DataFrame:
        """(_rep, _bound): an angle within which each query's cell surely holds k vectors, from its leaves' sizes and
        radii alone; 4.0, more than any angle, where it does not hold so many."""

        def bound(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    q = _column_matrix(batch.column("_vec")[i].values)
                    flat = batch.column("s_flat")[i].values.to_numpy(zero_copy_only=False)
                    sub, r, n = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("l_sub", "l_r", "l_n"))
                    pivots = _unit_rows(flat, len(flat) // q.shape[1])[sub]
                    found = np.zeros(len(q))
                    for part in _chunks(len(q), len(sub)):
                        far = _angles(q[part] @ pivots.T) + r[None, :]
                        order = np.argsort(far, axis=1)
                        enough = np.cumsum(n[order], axis=1) >= k
                        at = enough.argmax(axis=1)
                        rows = np.arange(len(far))
                        found[part] = np.where(enough[rows, at], far[rows, order[rows, at]], 4.0)
                    yield pa.RecordBatch.from_arrays([batch.column("_rep")[i].values, pa.array(found)], ["_rep", "_bound"])

        rep = queries.schema["_rep"].dataType.simpleString()
        return self._with_table(queries, ["_rep", "_vec"], self._reach).mapInArrow(bound, f"_rep {rep}, _bound DOUBLE")

    def own_visits(self, queries: DataFrame) -> DataFrame:
        """Each query's visit to its own leaf; a leaf without targets has none."""
        return queries.select("_rep", "_vec", "_cell", "_sub").join(
            broadcast_if_small(self.leaves.select("_cell", "_sub", "_parts")), ["_cell", "_sub"]
        ).select("_rep", "_vec", "_cell", "_sub", "_parts")

    def meet(self, visits: DataFrame) -> DataFrame:
        """Query blocks next to the target blocks of the leaf they visit.

        Visits are counted per leaf, so query blocks are full whatever a leaf's share of them. They
        are copied to every part of their leaf and meet it by (leaf, part), which spreads a crowded
        leaf over as many keys as it has blocks.
        """
        visits = cut_lineage(visits, "visits")
        counts = visits.groupBy("_cell", "_sub").agg(F.ceil(F.count(F.lit(1)) / self.block).cast("int").alias("_qparts"))
        packed = visits.join(broadcast_if_small(cut_lineage(counts, "visit-counts")), ["_cell", "_sub"])
        packs = (
            packed.groupBy("_cell", "_sub", "_parts", F.pmod(F.xxhash64("_rep"), F.col("_qparts")).alias("_qpart"))
            .agg(F.collect_list(F.struct("_rep", "_vec")).alias("_rows"))
            .select(
                "_cell", "_sub", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1).cast("array<bigint>")).alias("_part"),
                F.col("_rows._rep").alias("q_ids"), F.flatten("_rows._vec").alias("q_flat"),
            )
        )
        return packs.join(self.blocks, ["_cell", "_sub", "_part"]).select("q_ids", "q_flat", "t_ids", "t_copies", "t_flat")

    def dense(self, queries: DataFrame) -> bool:
        """Whether a probe of the queries reaches more than ``DENSE`` of the targets: a choice of plan, not of rows."""
        probes = cut_lineage(sample_n(queries, PROBES, "_rep"), "probes")
        reached = self.reachable(probes).select("_cell", "_sub").join(self.leaves, ["_cell", "_sub"]).agg(F.sum("n").alias("n")).first()["n"]
        return (reached or 0) > DENSE * probes.count() * self.n

    def grid(self, queries: DataFrame, columns: list[str]) -> DataFrame:
        """Every pack of queries next to every pack of targets, each pair in one row; ``columns`` of the queries go along."""
        width = int(self._shared.value.shape[1])
        most = max(1, GRID_BYTES // (8 * max(width, 1)))
        queries = cut_lineage(queries.select("_rep", "_vec", *columns), "asked")
        rows = lambda n: min(most, max(self.block, ceil(n / 16)))
        q_packs, t_packs = (max(1, ceil(n / rows(n))) for n in (queries.count(), self.n))

        def packed(df, key, n, fields):
            parts = df.groupBy(F.pmod(F.xxhash64("_vec"), F.lit(n)).alias(key)).agg(F.collect_list(F.struct(*fields, "_vec")).alias("_rows"))
            return parts.select(key, *[F.col(f"_rows.{c}").alias(f"{key}{c}") for c in fields], F.flatten("_rows._vec").alias(f"{key}_flat"))

        q = packed(queries, "q", q_packs, ["_rep", *columns]).withColumn("t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(t_packs - 1).cast("bigint"))))
        t = packed(self.homed, "t", t_packs, ["_rep", "_copies"]).withColumn("q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(q_packs - 1).cast("bigint"))))
        return q.join(t, ["q", "t"]).drop("q", "t")


def _block_pairs(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            q_ids, q, t_ids, copies, t = (
                c[i].values.to_numpy(zero_copy_only=False) for c in batch.columns
            )
            yield q_ids, _unit_rows(q, len(q_ids)), t_ids, copies.astype(np.int64), _unit_rows(t, len(t_ids))


def _best_in_blocks(pairs: DataFrame, k: int, own: bool, rep_type: str) -> DataFrame:

    def best(batches):
        for q_ids, q, t_ids, copies, t in _block_pairs(batches):
            mine = (q_ids[:, None] == t_ids[None, :]).astype(np.int64) if own else None
            found = _best(q @ t.T, copies, mine, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_ids), pa.array(found, type=pa.list_(pa.float64()))], ["_rep", "_sims"]
            )

    return pairs.mapInArrow(best, f"_rep {rep_type}, _sims ARRAY<DOUBLE>")


def _tiles(q: np.ndarray, t: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    for a in _chunks(len(q), 1, 1024):
        for b in _chunks(len(t), 1, TILE // 1024):
            yield a, b, q[a] @ t[b].T


def _grid_rows(batches, columns: list[str]) -> Iterator[tuple]:
    """Per pair of packs the queries' ids, columns and unit vectors, the targets' ids, copies and unit vectors."""
    for batch in batches:
        for i in range(batch.num_rows):
            x = {name: batch.column(name)[i].values.to_numpy(zero_copy_only=False) for name in batch.schema.names}
            q_ids, t_ids = x["q_rep"], x["t_rep"]
            yield (q_ids, *(x[f"q{c}"] for c in columns), _unit_rows(x["q_flat"], len(q_ids)), t_ids, x["t_copies"].astype(np.int64), _unit_rows(x["t_flat"], len(t_ids)))


def _raised(best: np.ndarray, i: np.ndarray, s: np.ndarray) -> np.ndarray:
    """``best`` (descending figures per row) with the figures s of rows i merged in."""
    k = best.shape[1]
    order = np.lexsort((-s, i))
    i, s = i[order], s[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    kept = rank < k
    more = np.full(best.shape, -np.inf)
    more[i[kept], rank[kept]] = s[kept]
    return -np.sort(-np.hstack((best, more)), axis=1)[:, :k]


def _best_in_grid(pairs: DataFrame, k: int, own: bool, rep_type: str) -> DataFrame:
    """The k largest similarities of each query in each pack of targets, none below those that its ``_reach`` allows."""

    def best(batches):
        for q_ids, reach, q, t_ids, copies, t in _grid_rows(batches, ["_reach"]):
            floor = np.where(reach + SLACK < np.pi, np.cos(np.minimum(reach + SLACK, np.pi)), -2.0)
            top = np.full((len(q_ids), k), -np.inf)
            for a, b, sims in _tiles(q, t):
                i, j = np.nonzero(sims >= np.maximum(floor[a], top[a, -1])[:, None])
                if not len(i):
                    continue
                times = copies[b][j]
                if own:
                    times = times - (q_ids[a][i] == t_ids[b][j])
                top[a] = _raised(top[a], np.repeat(i, times), np.repeat(sims[i, j], times))
            known = top > -np.inf
            some = known.any(axis=1)
            ends = np.concatenate(([0], np.cumsum(known[some].sum(axis=1)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(top[some][known[some]]))
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[some]), lists], ["_rep", "_sims"])

    return pairs.mapInArrow(best, f"_rep {rep_type}, _sims ARRAY<DOUBLE>")


def _merge(lists: DataFrame, k: int) -> DataFrame:
    """k largest over all lists of a query, in two steps so that no buffer sees them all."""
    best = F.slice(F.sort_array(F.flatten(F.collect_list("_sims")), asc=False), 1, k)
    salted = lists.withColumn("_salt", F.pmod(F.xxhash64("_sims"), F.lit(32)))
    return (
        salted.groupBy("_rep", "_salt").agg(best.alias("_sims"))
        .groupBy("_rep").agg(best.alias("_sims"))
    )


def _reaching(cells: _Cells, asked: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """Queries with the angle ``_reach`` beyond which no neighbour is needed.

    It is that of the k-th similarity found in the query's own leaf; where the leaf holds fewer, the
    one within which its cell holds k others.
    """
    found = F.acos(F.least(F.greatest(F.get("_sims", F.lit(k - 1)), F.lit(-1.0)), F.lit(1.0)))
    met = asked.join(near, "_rep", "left").withColumn("_met", F.when(F.size("_sims") >= k, found)).drop("_sims")
    met = cut_lineage(met, "met")
    bounds = cells.bounds(met.filter("_met IS NULL"), k + 1)
    return met.join(bounds, "_rep", "left").withColumn("_reach", F.coalesce("_met", "_bound", F.lit(4.0))).drop("_met", "_bound")


def _knn_cells(
    queries: DataFrame, targets: DataFrame, id_col: str, target_id: str, vec: str, k: int, own: bool,
    pivots: int | None, block: int,
) -> DataFrame:
    cells = _Cells(_distinct(targets, target_id, vec, k + 1), pivots, block)
    if own:
        asked = cells.homed
    else:
        located = cells.locate(_distinct(queries, id_col, vec, 1)).drop("_angle")
        asked = cut_lineage(cells.settle(located, ["_rep", "_vec"]), "asked")
    rep = asked.schema["_rep"].dataType.simpleString()
    near = cut_lineage(_merge(_best_in_blocks(cells.meet(cells.own_visits(asked)), k, own, rep), k))
    bound = _reaching(cells, asked, near, k)
    bound = cut_lineage(bound, "bound")
    if cells.dense(bound):
        best = _merge(_best_in_grid(cells.grid(bound, ["_reach"]), k, own, rep), k)
    else:
        far = _best_in_blocks(cells.meet(cells.reachable(bound)), k, own, rep)
        best = _merge(near.unionByName(far), k)
    by_vec = asked.select("_rep", "_vec").join(best, "_rep")
    rows = queries.select(F.col(id_col).alias("_id"), F.col(vec).alias("_vec"))
    return rows.join(by_vec, "_vec").select("_id", "_sims")


# ---- operators -----------------------------------------------------------------------------

def _size(df: DataFrame, vec: str) -> tuple[int, int]:
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(vec)), F.lit(0)).alias("x")
    ).first()
    return row["n"], row["x"] * 8


def _nearest(queries, targets, id_col, target_id, vec, k, own, max_bytes, pivots, block):
    if k < 1:
        raise ValueError("k must be at least 1")
    n, size = _size(targets, vec)
    if n < k + own:
        raise ValueError(f"{n} target rows are too few for {k} neighbours")
    if size <= max_bytes:
        return _knn_broadcast(queries, targets, id_col, target_id, vec, k, own)
    return _knn_cells(queries, targets, id_col, target_id, vec, k, own, pivots, block)


def _mean(k: int):
    return F.aggregate("_sims", F.lit(0.0), lambda a, x: a + x) / k


def knn_realism(
    gen: DataFrame, real: DataFrame, k: int = 5, id_col: str = "id", real_id: str | None = None,
    vec: str = "embedding", threshold: float = 0.9, max_bytes: int = KNN_BROADCAST_BYTES,
    pivots: int | None = None, block: int = BLOCK,
) -> DataFrame:
    """Mean cosine of the k nearest real rows, the nearest one, and the overlap flag."""
    found = _nearest(gen, real, id_col, real_id or id_col, vec, k, False, max_bytes, pivots, block)
    return found.select(
        F.col("_id").alias(id_col), _mean(k).alias("realism_sbert_topk"),
        F.col("_sims")[0].alias("nn_overlap"),
        overlap_flag(F.col("_sims")[0], threshold).alias("nn_overlap_flag"),
    )


def knn_self_similarity(
    df: DataFrame, k: int = 5, id_col: str = "id", vec: str = "embedding",
    max_bytes: int = KNN_BROADCAST_BYTES, pivots: int | None = None, block: int = BLOCK,
) -> DataFrame:
    """Mean cosine of the k nearest other rows, over all groups together."""
    found = _nearest(df, df, id_col, id_col, vec, k, True, max_bytes, pivots, block)
    return found.select(F.col("_id").alias(id_col), _mean(k).alias("inter_review_sim_topk"))


def overlap_pairs(
    gen: DataFrame, real: DataFrame, threshold: float = 0.9, id_col: str = "id",
    real_id: str | None = None, vec: str = "embedding", pivots: int | None = None, block: int = BLOCK,
) -> DataFrame:
    """Distinct vectors of both sides with cosine >= threshold, exact.

    Rows are (gen_id, real_id, similarity, gen_copies, real_copies): copies of one vector are one
    row with their number and smallest id, so a hot group of copies does not multiply out.
    """
    cells = _Cells(_distinct(real, real_id or id_col, vec), pivots, block)
    asked = cut_lineage(
        _distinct(gen, id_col, vec)
        .withColumn("_reach", F.lit(float(np.arccos(threshold))))
        .withColumns({"_cell": F.lit(-1), "_sub": F.lit(-1)})
    )
    asked = asked.withColumn("_copies", F.col("_copies").cast("bigint"))
    rep = asked.schema["_rep"].dataType.simpleString()
    t_rep = cells.homed.schema["_rep"].dataType.simpleString()
    if cells.dense(asked):
        def met(batches):
            for q_ids, q_copies, q, t_ids, copies, t in _grid_rows(batches, ["_copies"]):
                for a, b, sims in _tiles(q, t):
                    i, j = np.nonzero(sims >= threshold)
                    if len(i):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(q_ids[a][i]), pa.array(t_ids[b][j]), pa.array(sims[i, j]), pa.array(q_copies[a][i]), pa.array(copies[b][j])],
                            ["gen_id", "real_id", "similarity", "gen_copies", "real_copies"],
                        )

        return cells.grid(asked, ["_copies"]).mapInArrow(
            met, f"gen_id {rep}, real_id {t_rep}, similarity DOUBLE, gen_copies BIGINT, real_copies BIGINT"
        )
    pairs = cells.meet(cells.reachable(asked))

    def match(batches):
        for q_ids, q, t_ids, copies, t in _block_pairs(batches):
            sims = q @ t.T
            i, j = np.nonzero(sims >= threshold)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_ids[i]), pa.array(t_ids[j]), pa.array(sims[i, j]), pa.array(copies[j])],
                ["gen_id", "real_id", "similarity", "real_copies"],
            )

    hits = pairs.mapInArrow(
        match, f"gen_id {rep}, real_id {t_rep}, similarity DOUBLE, real_copies BIGINT"
    )
    own = asked.select(F.col("_rep").alias("gen_id"), F.col("_copies").cast("bigint").alias("gen_copies"))
    return hits.join(own, "gen_id").select(
        "gen_id", "real_id", "similarity", "gen_copies", "real_copies"
    )
