"""Operator 7: repeated spans of words by compaction of a sampled de Bruijn graph.

Edges are token k-mers. Of the 24 12-word k-mers in a window of 35 words the smallest by hash is the
window's edge; only edges that are smallest in some window enter the graph, about one word in twelve.
An arc leads from an edge to the next one of its text and is known by all words of both and between.
One count over the corpus keeps the edges that stand more than once and tells which of them have one
arc in, or one arc out, at all of their places.

Where an edge's only arc out is the next edge's only arc in, the two are on one nonbranching path.
Paths are compacted by joins that double what each edge knows of the way before it, so every edge
learns its path, its distance from the path's start and the path's length in words. A path stands as
a whole wherever one of its edges does, with the same words: its source coordinates in a text follow
from the place of any of its edges, and every window inside of a long one is repeated. Windows whose
edge is repeated and that reach over a path's ends, or lie on a path shorter than they are, are
verified one by one over their source coordinates, by a count of the hash of all their words. A window
inside of a path is so at all its occurrences, as its edge is; so all occurrences are decided alike.

Equal texts are one text with a copy count. A text's identity is a 64-bit hash and its byte length, a
k-mer's a 64-bit hash, a window's two 64-bit hashes.

Defined cases: a null text has no words; a text of fewer than 35 words keeps everything; rows are
told apart by their text, so null and repeated ids change nothing; an empty table gives an empty
result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from ..sizing import broadcast_if_small
from . import arrays as A

SPAN = 35
KMER = 12
MAX_EDGES = 2_000_000  # rows of the graph that may be broadcast


def _sliding(h: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every ``width`` consecutive entries."""
    if len(h) < width:
        return h[:0]
    done, out = 1, h
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


def window_edges(kmers: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest of every ``width`` consecutive k-mers, and the places of those that are it."""
    least = _sliding(kmers, width, np.minimum)
    if not len(least):
        return least, np.zeros(0, np.int64)
    edge = np.zeros(width - 1, A.U64)
    return least, np.flatnonzero(_sliding(np.concatenate((edge, least, edge)), width, np.maximum) == kmers)



def _stretches(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of the words lo[i]:hi[i] of each stretch, none of them empty; never 0."""
    size = hi - lo
    at = np.cumsum(size) - size
    place = A.spread(np.zeros(len(size), np.int64), size)
    factors = A.constants(int(size.max()))
    return A.mix(np.add.reduceat(h[A.spread(lo, size)] * factors[place], at) + size.astype(A.U64)) | A.U64(1)


SCAN = "tid BIGINT, size INT, edges ARRAY<BIGINT>, arcs ARRAY<BIGINT>, gaps ARRAY<INT>"


def _scan(span: int, k: int):
    """Every text's edges, the arc in to each (0 at the text's start) and its length in words."""
    width = span - k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in A.text_chunks(batches, "text"):
            w = A.split_words(t)
            h = A.word_hashes(t, w)
            edges, arcs, gaps = [], [np.zeros(0, A.U64)], [np.zeros(0, np.int64)]
            for i in range(len(t)):
                own = h[w.first[i] : w.first[i + 1]]
                kmers = A.run_hashes(own, k)
                _, at = window_edges(kmers, width)
                edges.append(kmers[at])
                if len(at):
                    arcs += [np.zeros(1, A.U64), *([_stretches(own, at[:-1], at[1:] + k)] if len(at) > 1 else [])]
                    gaps += [np.zeros(1, np.int64), np.diff(at)]
            sizes = np.array([len(e) for e in edges])
            yield pa.RecordBatch.from_arrays(
                [
                    t.rows.column("tid"), t.rows.column("size"),
                    A.list_array(A.as_long(np.concatenate(edges)), sizes, pa.int64()),
                    A.list_array(A.as_long(np.concatenate(arcs)), sizes, pa.int64()),
                    A.list_array(np.concatenate(gaps).astype(np.int32), sizes, pa.int32()),
                ],
                ["tid", "size", "edges", "arcs", "gaps"],
            )

    return run


DECIDED = "tid BIGINT, size INT, spans ARRAY<INT>, at ARRAY<INT>, h1 ARRAY<BIGINT>, h2 ARRAY<BIGINT>"


def _decide(span: int, k: int):
    """Per text: spans of windows inside of paths, and the places and hashes of other windows with repeated edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in A.text_chunks(batches, "text"):
            w = A.split_words(t)
            h = A.word_hashes(t, w)
            known = t.rows.column("known")
            spans, places = [], []
            for i in range(len(t)):
                fields = known[i].values
                edge, before, after = (fields.field(j).to_numpy(zero_copy_only=False) for j in range(3))
                order = np.argsort(edge.view(A.U64))
                edge, before, after = edge.view(A.U64)[order], before[order].astype(np.int64), after[order].astype(np.int64)
                kmers = A.run_hashes(h[w.first[i] : w.first[i + 1]], k)
                least, at = window_edges(kmers, span - k + 1)
                inside = np.zeros(len(least), bool)
                which = np.minimum(np.searchsorted(edge, kmers[at]), len(edge) - 1)
                met = edge[which] == kmers[at]
                at, which = at[met], which[met]
                for lo, hi in set(zip((at - before[which]).tolist(), (at + after[which] - span + 1).tolist())):
                    if hi > lo:
                        inside[lo:hi] = True
                spans.append(merge(np.flatnonzero(inside), span))
                places.append(np.flatnonzero(np.isin(least, edge) & ~inside))
            sizes = np.array([len(p) for p in places])
            at = np.concatenate(places)
            flat = at + np.repeat(w.first[:-1], sizes)
            none = np.zeros(0, A.U64)
            one = A.run_hashes(h, span)[flat] if len(flat) else none
            two = A.run_hashes(A.mix(h + A.U64(0x9E3779B97F4A7C15)), span)[flat] if len(flat) else none
            yield pa.RecordBatch.from_arrays(
                [
                    t.rows.column("tid"), t.rows.column("size"),
                    A.list_array(np.concatenate(spans).astype(np.int32), np.array([len(s) for s in spans]), pa.int32()),
                    A.list_array(at.astype(np.int32), sizes, pa.int32()),
                    A.list_array(A.as_long(one), sizes, pa.int64()), A.list_array(A.as_long(two), sizes, pa.int64()),
                ],
                ["tid", "size", "spans", "at", "h1", "h2"],
            )

    return run


def merge(starts: np.ndarray, span: int) -> np.ndarray:
    """Sorted window starts as disjoint spans: start, end, start, end, ..."""
    if not len(starts):
        return np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate(([True], np.diff(starts) > span)))
    stop = np.concatenate((new[1:], [len(starts)])) - 1
    return np.stack((starts[new], starts[stop] + span), 1).ravel()


def _joined(span: int):
    """Decided spans and verified window places of each text as one list of disjoint spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for own, places in zip(batch.column("spans").to_pylist(), batch.column("places").to_pylist()):
                starts = [np.arange(lo, hi - span + 1) for lo, hi in zip(own[::2], own[1::2])]
                spans.append(merge(np.unique(np.concatenate([np.array(places or [], np.int64), *starts])), span))
            sizes = np.array([len(x) for x in spans])
            flat = np.concatenate([np.zeros(0, np.int64), *spans]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("tid"), batch.column("size"), A.list_array(flat, sizes, pa.int32())], ["tid", "size", "spans"]
            )

    return run


REMOVED = "doc_id BIGINT, n_words BIGINT, n_removed BIGINT, kept_text STRING"


def _cut(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in A.text_chunks(iter([batch]), "text"):
                spans, whole = (t.rows.column(c).to_pylist() for c in ("spans", "whole"))
                n, gone, kept = [], [], []
                for i in range(len(t)):
                    words = t.raw(i).split()  # bytes split at the ASCII white space of the contract
                    keep = words
                    if whole[i] and len(words) >= span:
                        keep = []
                    elif spans[i]:
                        flags = np.ones(len(words), bool)
                        for lo, hi in zip(spans[i][::2], spans[i][1::2]):
                            flags[lo:hi] = False
                        keep = [x for x, f in zip(words, flags) if f]
                    n.append(len(words))
                    gone.append(len(words) - len(keep))
                    kept.append(b" ".join(keep).decode())
                yield pa.RecordBatch.from_arrays(
                    [t.rows.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_text"],
                )

    return run


KEY = ["tid", "size"]


def compacted(graph: DataFrame, k: int) -> DataFrame:
    """(edge, before, after) of repeated edges (edge, arc_in, arc_out, gap): the words of its path before the
    edge's start and from there on. Arcs are null where there are several; ``gap`` is that of ``arc_in``.

    Every round joins an edge with the edge it knows to be before it and so doubles the way known. A
    path cannot close on itself, as the last place of its edges in a text has no arc out.
    """
    start = graph.filter("arc_in <> 0").select("edge", "gap", F.col("arc_in").alias("arc"))
    end = graph.filter("arc_out <> 0").select(F.col("edge").alias("back"), F.col("arc_out").alias("arc"))
    now = cut_lineage(start.join(end, "arc").select("edge", "back", F.col("gap").alias("far")), "path-arcs")
    while True:
        further = now.select(F.col("edge").alias("back"), F.col("back").alias("_back"), F.col("far").alias("_far"))
        now = cut_lineage(now.join(further, "back", "left").select(
            "edge", F.coalesce("_back", "back").alias("back"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"),
            F.col("_back").isNotNull().alias("moved"),
        ), "paths")
        if now.filter("moved").isEmpty():
            break
    sizes = now.groupBy("back").agg((F.max("far") + k).alias("whole"))
    on_path = graph.select("edge").join(now.select("edge", "back", "far"), "edge", "left").select(
        "edge", F.coalesce("back", "edge").alias("back"), F.coalesce("far", F.lit(0)).alias("before")
    )
    return on_path.join(sizes, "back", "left").select(
        "edge", F.col("before").cast("int").alias("before"), (F.coalesce("whole", F.lit(k)) - F.col("before")).cast("int").alias("after")
    )


def repeated_windows(docs: DataFrame, span: int, k: int) -> DataFrame:
    """(tid, size, spans) of each text with repeated windows; ``docs`` has one row per text."""
    scan = cut_lineage(docs.mapInArrow(_scan(span, k), SCAN), "edges")
    out = F.concat(F.slice("arcs", F.lit(2), F.greatest(F.size("arcs") - 1, F.lit(0))), F.array(F.lit(0).cast("bigint")))
    places = scan.filter(F.size("edges") > 0).withColumn("outs", out)
    places = places.select(*KEY, F.explode(F.arrays_zip("edges", "arcs", "outs", "gaps")).alias("x"))
    places = places.select(*KEY, *[F.col(f"x.{c}").alias(c) for c in ("edges", "arcs", "outs", "gaps")])
    single = lambda c, of: F.when(F.min(c) == F.max(c), F.min(of))
    graph = places.groupBy(F.col("edges").alias("edge")).agg(
        F.count(F.lit(1)).alias("n"), single("arcs", "arcs").alias("arc_in"), single("outs", "outs").alias("arc_out"), single("arcs", "gaps").alias("gap")
    ).filter("n > 1").drop("n")
    graph = cut_lineage(compacted(cut_lineage(graph, "graph"), k), "edges-on-paths")
    on_path = places.select(*KEY, F.col("edges").alias("edge")).join(broadcast_if_small(graph, MAX_EDGES), "edge").distinct()
    known = on_path.groupBy(*KEY).agg(F.collect_list(F.struct("edge", "before", "after")).alias("known"))
    decided = docs.join(broadcast_if_small(cut_lineage(known, "known")), KEY).mapInArrow(_decide(span, k), DECIDED)
    decided = cut_lineage(decided, "decided")
    windows = decided.filter(F.size("at") > 0).select(*KEY, F.explode(F.arrays_zip("at", "h1", "h2")).alias("x"))
    windows = windows.select(*KEY, F.col("x.at").alias("at"), F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2"))
    again = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2")
    again = broadcast_if_small(cut_lineage(again, "again"), MAX_EDGES)
    verified = windows.join(again, ["h1", "h2"]).groupBy(*KEY).agg(F.collect_set("at").alias("places"))
    spans = decided.select(*KEY, "spans").dropDuplicates(KEY)
    found = spans.join(verified, KEY, "left").filter((F.size("spans") > 0) | F.col("places").isNotNull())
    return found.mapInArrow(_joined(span), "tid BIGINT, size INT, spans ARRAY<INT>")


def remove_repeats(docs: DataFrame, doc_id: str, text: str, span: int = SPAN, k: int = KMER) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: the words outside of repeated windows, joined by spaces."""
    words = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select(
        F.col(doc_id).alias("doc_id"), words.alias("text"), F.xxhash64(words).alias("tid"), F.octet_length(words).alias("size")
    )
    any_id = F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("bigint"))
    copies = docs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min(any_id).alias("first")).filter("n > 1")
    copies = broadcast_if_small(cut_lineage(copies.select(*KEY, "first"), "copies"))
    marked = docs.join(copies, KEY, "left")
    one_each = marked.filter(F.col("first").isNull() | (any_id == F.col("first"))).drop("first")
    found = broadcast_if_small(cut_lineage(repeated_windows(one_each, span, k), "repeats"))
    facts = marked.withColumn("whole", F.col("first").isNotNull()).drop("first").join(found, KEY, "left")
    cut = facts.select("doc_id", "text", "whole", "spans").mapInArrow(_cut(span), REMOVED)
    return cut.withColumnRenamed("doc_id", doc_id)
