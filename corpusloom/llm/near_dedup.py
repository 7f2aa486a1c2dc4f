"""Operator 3: near duplicates by bottom-k sketches of one hash function.

The k smallest hashes of a document's shingle set are its sketch. Inverted lists are keyed by runs
of consecutive retained values: two sets at the threshold agree on that share of their union's
smallest values, so they have some run in common, while documents that share only one passage seldom
do. The length of runs follows from the threshold: the greatest at which two large sets share none
with a chance of at most ``MISS`` (three from 0.80 to 0.85). Sets that a sketch holds whole are safe
by counting: where differing values can cut a union into shorter pieces, shorter runs are listed too.

Candidates are met in rounds, so that a group of n near copies costs about n pairs. First every
document meets the one list leader it shares most lists with. What is left are documents that stand
in a list spanning more than one component. They are listed again from their full sets, under a
prefix of their rarest shared shingles; shingles that no other of them has bound every overlap. While
the pairs of different components in these lists outnumber the rows of the lists, all rows of a list
meet its leader only: the document with the smallest share of shingles of its own, so the most central
one of a group of copies, outside of the components that led the list before. Documents that lack the same
shingle of a leader are a list too, as such copies lie closer to each other than to the leader. Rounds
end when two in a row leave most of the pairs; those of different components that are left in the prefix
lists then meet one by one, so no link rests on the choice of leaders. Every pair passes the sketch of its union (at least as many common values as a linked pair
has but for a chance of ``MISS``) and is then confirmed on the full shingle sets of both texts. Equal
sets are one node from the start. So a link of two sets right at the threshold, of more shingles than
a sketch holds, is lost with a chance of at most twice ``MISS``; above the threshold with a smaller one.

Defined cases: a null or wordless text has an empty set and is linked with nothing; a text of fewer
words than a shingle has its whole sequence as its one shingle; a null id is never linked and always
kept; rows that share an id are one node and the largest of their texts is the one compared; an
empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from ..sizing import broadcast_if_small
from . import arrays as A
from .components import connected_components

SHINGLE = 5
SKETCH = 64
SHRINK = 0.75  # a round of leaders that leaves a greater share of the pairs is idle
IDLE = 2  # idle rounds in a row that end the rounds of leaders
MISS = 1e-9  # chance that two large sets at the threshold share no list, or fail the sketch filter


def shingle_sets(t: A.Texts, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 63-bit hashes of every text's shingles; letters A-Z count as a-z."""
    w = A.split_words(t)
    h = A.word_hashes(t, w, A.LOWER)
    runs = A.run_hashes(h, width) >> A.U64(1)
    sets = []
    for i in range(len(t)):
        lo, hi = int(w.first[i]), int(w.first[i + 1])
        if hi - lo >= width:
            s = np.sort(runs[lo : hi - width + 1])
            sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif hi > lo:
            sets.append(A.run_hashes(np.concatenate((h[lo:hi], [A.U64(hi - lo)])), hi - lo + 1) >> A.U64(1))
        else:
            sets.append(np.zeros(0, A.U64))
    return sets


SKETCH_SCHEMA = "doc_id BIGINT, n_shingles BIGINT, set_sum BIGINT, set_mix BIGINT, sketch ARRAY<BIGINT>"


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in A.text_chunks(batches, "text"):
            sets = shingle_sets(t)
            low = [s[:k] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    t.rows.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([int(s.sum(dtype=A.U64).view(np.int64)) for s in sets], pa.int64()),
                    pa.array([int(np.bitwise_xor.reduce(A.mix(s)).view(np.int64)) if len(s) else 0 for s in sets], pa.int64()),
                    A.list_array(A.as_long(np.concatenate(low)), np.array([len(s) for s in low]), pa.int64()),
                ],
                ["doc_id", "n_shingles", "set_sum", "set_mix", "sketch"],
            )

    return run


def no_run_chance(share: float, places: int, width: int) -> float:
    """Chance that ``places`` independent hits of chance ``share`` hold no ``width`` in a row."""
    ends = [1.0] + [0.0] * (width - 1)  # by the number of hits the row ends with
    for _ in range(places):
        ends = [(1 - share) * sum(ends)] + [share * x for x in ends[:-1]]
    return sum(ends)


def least_hits(share: float, places: int) -> int:
    """The greatest number below which ``places`` independent hits of chance ``share`` stay with at most ``MISS``."""
    below, hits = 0.0, 0
    while (below := below + comb(places, hits) * share**hits * (1 - share) ** (places - hits)) <= MISS:
        hits += 1
    return hits


def run_widths(percent: int, k: int) -> list[range]:
    """The lengths of the runs that sets of 0, 1, ..., k and of more shingles are listed under."""
    width = 1
    while width < k and no_run_chance(percent / 100, k, width + 1) <= MISS:
        width += 1

    def shared(union: int) -> int:
        """The longest run that two sets of this union share at least."""
        both = -(-percent * union // 100)
        return -(-both // (union - both + 1))

    unions = [range(n, min(100 * n // percent, k) + 1) for n in range(k + 1)]
    return [range(min([width, *map(shared, u)]) if n else width, width + 1) for n, u in enumerate(unions)] + [range(width, width + 1)]


def _run_keys(percent: int, k: int):
    """(doc, key) of every run of a sketch's consecutive values."""
    widths = run_widths(percent, k)
    shortest = np.array([w.start for w in widths])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False).view(A.U64)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            n = batch.column(2).to_numpy(zero_copy_only=False)
            least = shortest[np.minimum(n, k + 1)]
            first = np.cumsum(sizes) - sizes
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for width in range(int(shortest.min()), widths[-1].stop):
                many = np.where(least <= width, np.maximum(sizes - width + 1, 0), 0)
                at = A.spread(first, many)
                keys = A.run_hashes(values, width)[at] if len(at) else np.zeros(0, A.U64)
                for lo in range(0, len(at), 100_000):
                    part = slice(lo, lo + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids, many)[part], pa.int64()), pa.array(A.as_long(keys[part]), pa.int64())], ["doc", "key"]
                    )

    return run


def _compare(percent: int, with_gaps: bool):
    """(a, b, linked) and the shingles of a that b lacks, where a set linked with a may lack so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = shingle_lists(batch, "text_a")
            two = shingle_lists(batch, "text_b")
            linked, gaps = [], []
            for a, b in zip(one, two):
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
                few = with_gaps and 100 * (len(a) - both) <= (100 - percent) * len(a)
                gaps.append(np.setdiff1d(a, b, assume_unique=True) if few else a[:0])
            flat = np.concatenate(gaps) if gaps else np.zeros(0, A.U64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(linked, pa.bool_()),
                 A.list_array(A.as_long(flat), np.array([len(g) for g in gaps]), pa.int64())],
                ["a", "b", "linked", "gaps"],
            )

    return run


def shingle_lists(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
    for t in A.text_chunks(iter([batch]), column):
        yield from shingle_sets(t)


def compare_sets(docs: DataFrame, pairs: DataFrame, percent: int, with_gaps: bool = False) -> DataFrame:
    """(a, b, linked, gaps) of pairs of ids, from their full shingle sets. Texts meet by pair."""
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("doc_id"))
    texts = docs.join(broadcast_if_small(sides), "doc_id")
    met = texts.groupBy("a", "b").agg(
        F.max(F.when(F.col("doc_id") == F.col("a"), F.col("text"))).alias("text_a"),
        F.max(F.when(F.col("doc_id") == F.col("b"), F.col("text"))).alias("text_b"),
    )
    return met.mapInArrow(_compare(percent, with_gaps), "a BIGINT, b BIGINT, linked BOOLEAN, gaps ARRAY<BIGINT>")


def confirm_links(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full shingle sets reach the threshold."""
    return compare_sets(docs, pairs, percent).filter("linked").select("a", "b")


def sketch_filter(pairs: DataFrame, reps: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs whose sizes can reach the threshold and whose union sketch does not exclude it."""
    a = reps.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    b = reps.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    met = pairs.join(a, "a").join(b, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    p = percent / 100
    whole = (F.col("na") <= k) & (F.col("nb") <= k) & (F.size(F.array_union("sa", "sb")) <= k)
    least = F.when(whole, (F.lit(p) - 1e-9) * F.size(union)).otherwise(F.lit(least_hits(p, k)))
    return met.filter(both >= least).select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str, text: str, percent: int = 85, k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reached over links), kept (the id is that one)."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    sketched = cut_lineage(docs.mapInArrow(_sketches(k), SKETCH_SCHEMA), "sketches")
    set_key = ["n_shingles", "set_sum", "set_mix"]
    sets = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*set_key).agg(F.min("doc_id").alias("rep"))
    sets = cut_lineage(sets, "sets")
    fewest = next(n for n in range(1, 200) if 100 * n >= percent * (n + 1)) if percent < 100 else None
    members = sketched.select("doc_id", *set_key).join(sets, set_key, "left")
    if fewest is None:
        parts = None
    else:
        # a smaller set can only be linked with an equal one
        own = sets.filter(F.col("n_shingles") >= fewest).select(F.col("rep").alias("doc_id"), *set_key)
        reps = cut_lineage(sketched.join(own, ["doc_id", *set_key], "left_semi").dropDuplicates(["doc_id"])
                           .select("doc_id", "n_shingles", "sketch"), "reps")
        parts = _parts(docs, reps, percent, k)
    if parts is not None:
        members = members.join(parts, F.col("rep") == F.col("id"), "left").withColumn("rep", F.coalesce("component", "rep"))
    component = F.coalesce("rep", "doc_id")
    return members.select(
        F.col("doc_id").alias(doc_id), "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _parts(docs: DataFrame, reps: DataFrame, percent: int, k: int) -> DataFrame:
    """(id, component) of the linked representatives of sets."""
    entries = reps.select("doc_id", "sketch", "n_shingles").mapInArrow(_run_keys(percent, k), "doc BIGINT, key BIGINT")
    lists = entries.groupBy("key").agg(F.min("doc").alias("leader"), F.max("doc").alias("last")).filter("leader < last")
    entries = cut_lineage(entries.join(lists.select("key", "leader"), "key"), "entries")

    star = entries.filter("doc <> leader").groupBy("doc", "leader").agg(F.count(F.lit(1)).alias("n"))
    best = star.groupBy("doc").agg(F.max(F.struct("n", (-F.col("leader")).alias("m"))).alias("x"))
    first = best.select((-F.col("x.m")).alias("a"), F.col("doc").alias("b"))
    tested = cut_lineage(sketch_filter(first, reps, percent, k), "pairs")
    links = cut_lineage(confirm_links(docs, tested, percent), "links")
    parts = cut_lineage(connected_components(links, "a", "b"), "parts")

    # Documents that stand in a list spanning several components: a link that is left has both ends there.
    crossing = spanning(entries.select(F.col("key").alias("s"), "doc"), parts)
    sizes = reps.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"))
    still_open = cut_lineage(crossing.select("doc").distinct().join(sizes, "doc"), "open")
    lists = prefix_lists(docs, still_open, percent)

    gaps = lists.limit(0)
    led = lists.select("s", "doc").limit(0)
    held = cut_lineage(spanning(lists, parts), "lists")
    rows, left = _crowd(held, percent)
    idle = 0
    while left > rows and idle < IDLE:
        near = held.unionByName(spanning(gaps, parts))
        leaders = cut_lineage(list_leaders(near, led, parts), "leaders")
        met = cut_lineage(_untested(leader_pairs(near, leaders, percent), tested), "pairs")
        found = cut_lineage(compare_sets(docs, sketch_filter(met, reps, percent, k), percent, with_gaps=True), "compared")
        tested = tested.unionByName(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        fresh = found.filter("linked").select("a", "b")
        stars = parts.select(F.col("component").alias("a"), F.col("id").alias("b"))
        parts = cut_lineage(connected_components(stars.unionByName(fresh), "a", "b"), "parts")
        led = led.unionByName(leaders.select("s", F.col("leader").alias("doc")))
        gaps = gaps.unionByName(gap_lists(found, lists))
        held = cut_lineage(spanning(lists, parts), "lists")
        before = left
        rows, left = _crowd(held, percent)
        idle = 0 if left <= SHRINK * before else idle + 1

    pairs = cut_lineage(_untested(list_pairs(held, percent), tested), "pairs")
    more = confirm_links(docs, cut_lineage(sketch_filter(pairs, reps, percent, k), "pairs"), percent)
    stars = parts.select(F.col("component").alias("a"), F.col("id").alias("b"))
    return cut_lineage(connected_components(stars.unionByName(more), "a", "b"), "parts")


def spanning(lists: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows, with their component as ``part``, of lists (s, doc, ...) that hold more than one."""
    placed = lists.join(parts, F.col("doc") == F.col("id"), "left").withColumn("part", F.coalesce("component", "doc")).drop("id", "component")
    ends = placed.groupBy("s").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    return placed.join(ends.filter("lo < hi").select("s"), "s")


def _bounded(n, most, n_b, most_b, percent: int):
    """Whether sets of n and n_b shingles can be linked that have at most ``most`` and ``most_b`` in common."""
    most = F.least(most, most_b)
    return 100 * most >= percent * (F.col(n) + F.col(n_b) - most)


def class_pairs(lists: DataFrame, keys: list[str], percent: int, *more) -> DataFrame:
    """Pairs of classes (n, most) of rows with equal keys that the bounds do not rule out, each once.

    The bounds know no more of a row, so they are tested on classes, whose number does not follow that of the rows.
    """
    classes = lists.groupBy(*keys, "n", "most").agg(F.count(F.lit(1)).cast("double").alias("m"), *more)
    other = classes.select(*keys, *[F.col(c).alias(f"{c}_b") for c in classes.columns if c not in keys])
    return classes.join(other, keys).filter(
        (F.struct("n", "most") <= F.struct("n_b", "most_b")) & _bounded("n", "most", "n_b", "most_b", percent)
    )


def _crowd(lists: DataFrame, percent: int) -> tuple[float, float]:
    """The rows of the lists, and their pairs of different parts that the bounds do not rule out."""
    same = (F.col("n") == F.col("n_b")) & (F.col("most") == F.col("most_b"))
    met = F.sum(F.when(same, F.col("m") * (F.col("m") - 1) / 2).otherwise(F.col("m") * F.col("m_b"))).alias("x")
    every, within = (class_pairs(lists, keys, percent).agg(met).first()["x"] or 0.0 for keys in (["s"], ["s", "part"]))
    return lists.count(), every - within


def _untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    """The pairs that are not among the tested ones, whose a is the smaller id."""
    tested = tested.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    return pairs.join(tested, (F.least("a", "b") == F.col("_a")) & (F.greatest("a", "b") == F.col("_b")), "left_anti")


def list_leaders(lists: DataFrame, led: DataFrame, parts: DataFrame) -> DataFrame:
    """The row of the smallest share of lonely shingles of every list, outside of the parts of its former leaders."""
    former = led.join(parts, F.col("doc") == F.col("id"), "left").select("s", F.coalesce("component", "doc").alias("part")).distinct()
    first = F.min(F.struct((F.col("lonely") / F.col("n")).alias("share"), "doc", "part", "n", "most"))
    best = lists.join(former, ["s", "part"], "left_anti").groupBy("s").agg(first.alias("x"))
    return best.select("s", F.col("x.doc").alias("leader"), F.col("x.part").alias("part_l"), F.col("x.n").alias("nl"), F.col("x.most").alias("most_l"))


def leader_pairs(lists: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of leaders and rows of their lists, of different parts, that the bounds do not rule out."""
    return lists.join(leaders, "s").filter(
        (F.col("part") != F.col("part_l")) & _bounded("n", "most", "nl", "most_l", percent)
    ).select(F.col("leader").alias("a"), F.col("doc").alias("b")).distinct()


def gap_lists(compared: DataFrame, lists: DataFrame) -> DataFrame:
    """The rows of lists of documents that lack the same shingle of the same leader."""
    sizes = lists.select("doc", "n", "lonely").distinct()
    gaps = compared.select("a", F.col("b").alias("doc"), F.explode("gaps").alias("g")).join(sizes, "doc")
    rows = gaps.select(F.xxhash64("a", "g").alias("s"), "doc", "n", "lonely", (F.col("n") - F.col("lonely")).alias("most"))
    return cut_lineage(rows, "gaps")


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in A.text_chunks(batches, "text"):
        sets = shingle_sets(t)
        ids = np.repeat(t.rows.column("doc").to_numpy(zero_copy_only=False), [len(s) for s in sets])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(A.as_long(np.concatenate(sets)), pa.int64())], ["doc", "s"])


def prefix_lists(docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Rows (s, doc, n, lonely, most): members (doc, n) under the rarest shingles s they share with others.

    Over the members' full sets, shingles are ordered by how many members have them; those that one
    has alone are lonely. As linked sets lack at most a small share of each other's shingles, two of
    them meet in a prefix of their rarest ones, and the places of the first one they share bound what
    they can have in common: ``most``.
    """
    texts = docs.join(broadcast_if_small(members.select(F.col("doc").alias("doc_id"))), "doc_id").select(
        F.col("doc_id").alias("doc"), "text"
    )
    rows = cut_lineage(texts.mapInArrow(_shingle_rows, "doc BIGINT, s BIGINT").distinct(), "shingles")
    common = rows.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    held = rows.join(common, "s").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("shared"))
    lacking = F.col("n") - F.ceil(F.col("n") * percent / 100)  # of its shingles, in a set it is linked with
    lonely = F.col("n") - F.size("shared")
    prefix = held.join(members, "doc").withColumn("lonely", lonely).filter(F.col("lonely") <= lacking).select(
        "doc", "n", "lonely",
        F.posexplode(F.slice("shared", F.lit(1), (lacking + 1 - F.col("lonely")).cast("int"))).alias("i", "x"),
    )
    # No rarer shingle of the set is in the other one when this is the first they share.
    most = F.col("n") - F.col("lonely") - F.col("i")
    return cut_lineage(prefix.select(F.col("x.s").alias("s"), "doc", "n", "lonely", most.alias("most")), "prefixes")


def list_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different parts in the lists that the bounds do not rule out."""
    lists = lists.select("s", "n", "most", "part", "doc")
    met = class_pairs(lists, ["s"], percent, F.min("part").alias("lo"), F.max("part").alias("hi")).filter(
        F.least("lo", "lo_b") < F.greatest("hi", "hi_b")
    ).select("s", "n", "most", "n_b", "most_b")
    other = lists.toDF("s", "n_b", "most_b", "part_b", "doc_b")
    return lists.join(met, ["s", "n", "most"]).join(other, ["s", "n_b", "most_b"]).filter(
        (F.col("part") != F.col("part_b")) & (F.struct("n", "most", "doc") < F.struct("n_b", "most_b", "doc_b"))
    ).select(F.least("doc", "doc_b").alias("a"), F.greatest("doc", "doc_b").alias("b")).distinct()
