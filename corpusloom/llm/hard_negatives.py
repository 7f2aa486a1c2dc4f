"""Hard negatives by exact integer scores: Strassen products of anchor and candidate tiles, then bounded heaps.

Vectors become integers, floor(scale * x). Anchors and candidates are dealt into blocks of bounded
size; every cell of one anchor block and one candidate block is one task's group, whose score tiles
come from Strassen's recursion on int64 with zero padding. A first pass over the cells of each label
keeps the best positives, a second over all cells keeps, for every anchor and positive, the best
negatives inside the positive's score window. What a cell keeps are a few (score, id) entries per
anchor, which merge into those of other cells by a rank.

Cases with a defined result: rows with a null label, a null vector, or a null or non-finite component
take no part; shorter vectors count as filled with zeros, an empty one as all zeros; equal scores go by
smaller id, null ids last; rows that repeat are rows of their own, and a copy of an anchor under its id
can be its positive; anchors without positives, and positives without negatives in their window, give
no rows; an empty table gives none. Other columns are not carried, so none can clash. Scores must fit:
a vector whose squared length in integers exceeds 2**55 raises ``ValueError``.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from ..sizing import broadcast_if_small

LEAF = 32  # a product whose least side is at most this is not split further
ANCHOR_BLOCK = 16_384  # most rows of an anchor block, in expectation
CANDIDATE_BLOCK = 65_536
LEAST_BLOCK = 4_096  # candidate blocks of small tables, so that all cores have cells
TILE = (256, 2_048)  # scores held at a time
NONE = np.iinfo(np.int64).min
MAX_NORM = 1 << 55


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b; by floating point where every partial sum stays below 2**53 and so is exact."""
    fa, fb = a.astype(np.float64), b.astype(np.float64)
    if np.abs(fa).max(initial=0) * np.abs(fb).max(initial=0) * a.shape[1] < 2**53:
        return (fa @ fb).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices by seven half-size products.

    Sums wrap modulo 2**64, as do int64 products, so the result is exact whenever it fits int64.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return _leaf(a, b)
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2  # noqa: E741
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class Best:
    """For each row the k highest scores offered so far, the earliest offered first among equal ones."""

    def __init__(self, rows: int, k: int):
        self.scores = np.full((rows, k), NONE)
        self.places = np.zeros((rows, k), np.int64)

    def offer(self, scores: np.ndarray, first: int) -> None:
        """Scores of candidates ``first``, ``first + 1``, ...; NONE where a candidate is none of the row's."""
        rows = np.flatnonzero(scores.max(axis=1, initial=NONE) > self.scores[:, -1])
        if not len(rows):
            return
        left, k = scores[rows], self.scores.shape[1]
        found = [(self.scores[rows], self.places[rows])]
        at = np.arange(len(rows))
        for _ in range(min(k, left.shape[1])):
            top = left.argmax(axis=1)
            found.append((left[at, top][:, None], first + top[:, None]))
            left[at, top] = NONE
        both, places = (np.concatenate(x, axis=1) for x in zip(*found))
        order = _descending(both)[:, :k]
        self.scores[rows] = np.take_along_axis(both, order, 1)
        self.places[rows] = np.take_along_axis(places, order, 1)


def _descending(both: np.ndarray) -> np.ndarray:
    """Stable descending order; NONE has no negative of its own and comes last."""
    return np.argsort(np.where(both == NONE, np.iinfo(np.int64).max, -both), axis=1, kind="stable")


def _matrix(col: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers, zeros behind the shorter ones."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    ends = col.offsets.to_numpy()
    values = col.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    sizes = np.diff(ends)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], sizes)] = values
    return out


def _ints(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _tiles(anchors: pa.Table, candidates: pa.Table):
    """(anchor slice, first candidate, candidate slice, scores) of every tile of a cell."""
    width = max([0, *(x for t in (anchors, candidates) for x in np.diff(t["_q"].combine_chunks().offsets.to_numpy())[:])])
    a, c = _matrix(anchors["_q"], width), _matrix(candidates["_q"], width).T
    for i in range(0, len(a), TILE[0]):
        rows = slice(i, min(i + TILE[0], len(a)))
        for j in range(0, c.shape[1], TILE[1]):
            cols = slice(j, min(j + TILE[1], c.shape[1]))
            yield rows, j, cols, strassen(np.ascontiguousarray(a[rows]), np.ascontiguousarray(c[:, cols]))


def _in_id_order(candidates: pa.Table) -> pa.Table:
    return candidates.sort_by([("_null", "ascending"), ("_id", "ascending"), ("_row", "ascending")])


def _positives(k: int) -> Callable:
    def cell(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        candidates = _in_id_order(candidates)
        a_row, c_row = _ints(anchors, "_row"), _ints(candidates, "_row")
        best = {}
        for rows, j, cols, scores in _tiles(anchors, candidates):
            scores[a_row[rows, None] == c_row[None, cols]] = NONE
            best.setdefault(rows.start, Best(rows.stop - rows.start, k)).offer(scores, j)
        return _entries(anchors, candidates, [(i, b, None) for i, b in best.items()])

    return cell


def _negatives(k: int, low: int, high: int) -> Callable:
    def cell(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        candidates = _in_id_order(candidates)
        a_label, c_label = (anchors["_label"].combine_chunks().to_numpy(zero_copy_only=False), candidates["_label"].combine_chunks().to_numpy(zero_copy_only=False))
        found = anchors["_scores"].combine_chunks()
        sizes = np.diff(found.offsets.to_numpy())
        known = _matrix(found, max([0, *sizes]))
        # A positive of score s takes scores n with low * s <= 100 * n <= high * s.
        least, most = -((-low * known) // 100), (high * known) // 100
        given = np.arange(known.shape[1])[None, :] < sizes[:, None]
        best = {}
        for rows, j, cols, scores in _tiles(anchors, candidates):
            other = a_label[rows, None] != c_label[None, cols]
            for p in range(known.shape[1]):
                lo, hi = least[rows, p, None], most[rows, p, None]
                heap = best.setdefault((rows.start, p), Best(rows.stop - rows.start, k))
                inside = other & (scores >= np.maximum(lo, heap.scores[:, -1:])) & (scores <= hi) & given[rows, p, None]
                some = np.flatnonzero(inside.any(axis=1))
                if len(some):
                    part = Best(len(some), k)
                    part.scores, part.places = heap.scores[some], heap.places[some]
                    part.offer(np.where(inside[some], scores[some], NONE), j)
                    heap.scores[some], heap.places[some] = part.scores, part.places
        return _entries(anchors, candidates, [(i, b, p) for (i, p), b in best.items()])

    return cell


ENTRY = "_row BIGINT, _p INT, _score BIGINT, _other BIGINT, _other_row BIGINT"


def _entries(anchors: pa.Table, candidates: pa.Table, heaps: list) -> pa.Table:
    """One row per entry of the heaps; ``_other`` is null where the candidate's id is."""
    a_row, c_row, ids, gone = _ints(anchors, "_row"), _ints(candidates, "_row"), _ints(candidates, "_id"), _ints(candidates, "_null")
    parts = []
    for start, heap, p in heaps:
        r, s = np.nonzero(heap.scores != NONE)
        place = heap.places[r, s]
        parts.append((a_row[start + r], np.full(len(r), p or 0, np.int32), heap.scores[r, s], place))
    row, p, score, place = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int64))
    other = pa.array(ids[place], mask=gone[place] == 1)
    return pa.table({"_row": pa.array(row), "_p": pa.array(p, pa.int32()), "_score": pa.array(score), "_other": other, "_other_row": pa.array(c_row[place])})


def _first(entries: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best entries of each key, numbered from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col("_score").desc(), F.col("_other").asc_nulls_last(), "_other_row")
    return entries.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k)


def _dealt(of: str):
    return F.pmod(F.xxhash64("_row"), F.col(of)).cast("int")


def _others(of: str):
    return F.explode(F.sequence(F.lit(0), (F.col(of) - 1).cast("int")))


def _cells(anchors: DataFrame, candidates: DataFrame, keys: list[str], cell: Callable) -> DataFrame:
    """``cell`` on every anchor block with every candidate block; ``_na`` and ``_nc`` are the numbers of blocks."""
    a = anchors.withColumn("_r", _dealt("_na")).withColumn("_c", _others("_nc"))
    c = candidates.withColumn("_c", _dealt("_nc")).withColumn("_r", _others("_na"))
    c = c.toDF(*c.columns)  # names of its own: both sides come from one table
    keys = [*keys, "_r", "_c"]
    return a.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(cell, ENTRY)


def mine_hard_negatives(
    df: DataFrame, id_col: str, vector: str, label: str | Column, anchors: Column, positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows ``anchors`` selects.

    Positives are an anchor's best rows of its label; negatives the best rows of other labels whose
    score lies between ``low`` and ``high`` percent of the positive's, ranked from 1.
    """
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    label = F.col(label) if isinstance(label, str) else label
    chosen = df.select(
        F.col(id_col).cast("bigint").alias("_id"), label.cast("bigint").alias("_label"), F.col(vector).alias("_v"),
        F.coalesce(anchors, F.lit(False)).alias("_anchor"), bad.alias("_bad"),
    ).filter("_label IS NOT NULL AND _v IS NOT NULL AND NOT _bad")
    rows = cut_lineage(chosen.select(
        "_id", F.col("_id").isNull().cast("int").alias("_null"), "_label", "_anchor", F.monotonically_increasing_id().alias("_row"),
        F.transform("_v", lambda x: F.floor(x.cast("double") * scale)).alias("_q"),
    ), "vectors")
    norm = F.aggregate("_q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("_anchor").alias("a"), F.max(norm).alias("norm")).first()
    if (total["norm"] or 0) > MAX_NORM:
        raise ValueError("vectors are too long for exact scores in 64 bits")
    block = min(CANDIDATE_BLOCK, max(LEAST_BLOCK, ceil(total["n"] / (2 * df.sparkSession.sparkContext.defaultParallelism))))
    sizes = rows.groupBy("_label").agg(
        F.ceil(F.count_if("_anchor") / ANCHOR_BLOCK).cast("int").alias("_na"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nc")
    ).filter("_na > 0")
    labelled = rows.join(broadcast_if_small(cut_lineage(sizes, "labels")), "_label")
    a, c = ["_row", "_q", "_label"], ["_row", "_q", "_id", "_null", "_label"]
    found = _cells(labelled.filter("_anchor").select(*a, "_na", "_nc"), labelled.select(*c, "_na", "_nc"), ["_label"], _positives(positives))
    best = cut_lineage(_first(found, ["_row"], positives), "positives")
    known = best.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_rank", "_score"))).alias("_s"))
    known = known.select("_row", F.transform("_s", lambda s: s["_score"]).alias("_scores"))
    na, nc = max(1, ceil(total["a"] / ANCHOR_BLOCK)), max(1, ceil(total["n"] / block))
    all_rows = rows.withColumns({"_na": F.lit(na), "_nc": F.lit(nc)})
    found = _cells(
        all_rows.filter("_anchor").join(known, "_row").select(*a, "_scores", "_na", "_nc"), all_rows.select(*c, "_na", "_nc"),
        [], _negatives(negatives, low, high),
    )
    won = _first(found, ["_row", "_p"], negatives).select(
        "_row", F.col("_p") + 1, F.col("_rank").alias("rank"), F.col("_other").alias("negative_id"), F.col("_score").alias("negative_score")
    ).toDF("_row", "_place", "rank", "negative_id", "negative_score")
    pairs = best.select("_row", F.col("_rank").alias("_place"), F.col("_other").alias("positive_id"), F.col("_score").alias("positive_score"))
    names = rows.filter("_anchor").select("_row", F.col("_id").alias("anchor_id"))
    return won.join(pairs, ["_row", "_place"]).join(names, "_row").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
