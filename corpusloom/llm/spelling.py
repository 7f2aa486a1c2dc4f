"""Spelling variants: words one code point apart, found by pairs of numbered trie nodes.

Every prefix of a word is a node of the forward trie, every suffix one of the reversed trie. A word
with its place i skipped is the pair (node before i, node behind i); a word with a code point to be
inserted at i is the pair (node before i, node from i on). Two words that differ by one replaced code
point share a skipped pair; a longer word's skipped pair is a shorter one's inserted pair where one
code point is inserted. Both are plain equality joins on two integers, and every neighbour has exactly
one place: of a run of equal code points only the first is skipped. A node's number is a 64-bit hash
of its path, so that nodes are numbered without passing through one task; a pair whose numbers agree
is confirmed on the words themselves, and equal paths never differ in number, so neither is one missed.

Words that share a skipped pair differ in one code point of the alphabet alone, so no join key has more
rows than the alphabet has letters; copies of texts only raise counts, which are added up before
anything is joined.

Cases with a defined result: null and empty texts and runs shorter than ``least_length`` have no words;
a null id is an empty text in the hash; repeated rows count each; words as long as a text are handled
like any other; ties go to the smallest word in code-point order; an empty table gives no words. Only
the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.sampling import dense_id
from ..session import cut_lineage
from . import arrays as A

LETTERS = "a-zÀ-ÿ"  # after A-Z became a-z
SLIP = 97  # a word loses a code point where this divides its hash
CHUNK = 1 << 20  # characters looked at together
FLUSH = 200_000  # counted words that a task holds
U64 = np.uint64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_OTHER = re.compile(f"[^{LETTERS}]")


def _parts(text: str) -> Iterator[str]:
    """Slices of a text that end outside of words."""
    at = 0
    while at < len(text):
        end = _OTHER.search(text, at + CHUNK)
        end = end.start() if end else len(text)
        yield text[at:end]
        at = end


def slip(word: str, key: int) -> str:
    """The word without the code point its hash names, or as it is."""
    if key % SLIP:
        return word
    at = key % len(word)
    return word[:at] + word[at + 1 :]


def _count(least: int):
    runs = re.compile(f"[{LETTERS}]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return out

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                if not text.is_valid:
                    continue
                seed = zlib.crc32(f"{name.as_py() or ''}:".encode())
                for part in _parts(text.as_buffer().to_pybytes().translate(_LOWER).decode()):
                    for word, n in Counter(runs.findall(part)).items():
                        key = zlib.crc32(word.encode(), seed)
                        if key % SLIP == 0:
                            word = slip(word, key)
                            if len(word) < least:
                                continue
                        held[word] += n
                    if len(held) > FLUSH:
                        yield flush()
        if held:
            yield flush()

    return run


def word_counts(df: DataFrame, id_col: str, text: str, least_length: int = 5) -> DataFrame:
    """(word, n) over all texts; runs below the least length cannot give a word of it and are not hashed."""
    rows = df.select(F.col(id_col).cast("string").alias("i"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(_count(least_length), "word STRING, n BIGINT").groupBy("word").agg(F.sum("n").alias("n"))


SPLIT, SKIP, FIRST = 0, 1, 2  # an inserted place; a skipped one; a skipped one that does not follow its like


def pair_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word index, kind, node before, node behind) of every place of some words."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    size = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(size) - size
    place = np.arange(len(codes)) - np.repeat(start, size)
    power = A.powers(int(size.max(initial=0)) + 1)
    value = A.mix(codes.astype(U64) + U64(1))

    owner = np.repeat(np.arange(len(words)), size + 1)
    at = A.spread(start, size + 1)  # depth 0 .. size of each word, as places in the running totals
    depth = at - start[owner]

    def totals(exponent: np.ndarray) -> np.ndarray:
        return np.concatenate(([U64(0)], np.cumsum(value * power[exponent], dtype=U64)))

    total = totals(place)
    before = A.mix(total[at] - total[start][owner] + depth.astype(U64) * U64(0xA24BAED4963EE407))
    total = totals(np.repeat(size, size) - 1 - place)
    behind = A.mix(total[start + size][owner] - total[at] + (size[owner] - depth).astype(U64) * U64(0x9FB21C651E98DF25))
    skipped = np.flatnonzero(depth < size[owner])
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (place[1:] > 0)
    kind = np.where(same, SKIP, FIRST)
    return (
        np.concatenate((owner, owner[skipped])), np.concatenate((np.full(len(owner), SPLIT), kind)).astype(np.int8),
        np.concatenate((before, before[skipped])), np.concatenate((behind, behind[skipped + 1])),
    )


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ranks, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        ends = np.cumsum([len(w) for w in words])
        lo = 0
        while lo < len(words):
            begin = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, begin + (CHUNK >> 3), "right")))
            owner, kind, before, behind = pair_rows(words[lo:hi])
            yield pa.RecordBatch.from_pydict({
                "before": pa.array(A.as_long(before)), "behind": pa.array(A.as_long(behind)),
                "kind": pa.array(kind), "rank": pa.array(ranks[lo:hi][owner]),
            })
            lo = hi


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) with a < b: the ranks of all words of (rank, word) that differ by one code point."""
    rows = words.select("rank", "word").mapInArrow(_pairs, "before BIGINT, behind BIGINT, kind TINYINT, rank BIGINT")
    rows = cut_lineage(rows, "nodes")
    on = ["before", "behind"]
    skipped = rows.filter(F.col("kind") != SPLIT).select(*on, F.col("rank").alias("a"))
    again = rows.filter(F.col("kind") != SPLIT).select(*on, F.col("rank").alias("b"))
    longer = rows.filter(F.col("kind") == FIRST).select(*on, F.col("rank").alias("b"))
    shorter = rows.filter(F.col("kind") == SPLIT).select(*on, F.col("rank").alias("a"))
    replaced = skipped.join(again, on).filter("a < b").select("a", "b")
    inserted = shorter.join(longer, on).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return confirmed(replaced.unionByName(inserted), words)


def confirmed(found: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs whose words do differ by one code point, as numbers are hashes."""
    one, other = words.select(F.col("rank").alias("a"), F.col("word").alias("_a")), words.select(F.col("rank").alias("b"), F.col("word").alias("_b"))
    return found.join(one, "a").join(other, "b").filter(F.levenshtein("_a", "_b", 1) == 1).select("a", "b")


def roots(links: DataFrame) -> DataFrame:
    """(rank, root) for (rank, up) links without circles: each round follows twice as many links as the one before."""
    now = cut_lineage(links.select("rank", "up"), "links")
    while True:
        above = now.select(F.col("rank").alias("up"), F.col("up").alias("_next"))
        now = cut_lineage(
            now.join(above, "up", "left").select("rank", F.coalesce("_next", "up").alias("up"), F.col("_next").isNotNull().alias("_moved")), "links"
        )
        if now.filter("_moved").isEmpty():
            return now.select("rank", F.col("up").alias("root"))


def spelling_variants(df: DataFrame, id_col: str, text: str, least_length: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    ``form`` is the near word of the largest count, if that is at least ``ratio`` times the word's
    own; ``root`` is where following forms ends.
    """
    counted = word_counts(df, id_col, text, least_length).filter(F.col("n") >= least_count)
    # Ranks by count, then word: a near word of the largest count is the one of the least rank.
    words = cut_lineage(dense_id(counted, [-F.col("n"), "word"], name="rank"), "words")
    pairs = cut_lineage(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("rank"), F.col("b").alias("o")).unionByName(pairs.select(F.col("b").alias("rank"), F.col("a").alias("o")))
    near = both.groupBy("rank").agg(F.count(F.lit(1)).alias("n_near"), F.min("o").alias("up"))
    best = words.select(F.col("rank").alias("up"), F.col("word").alias("_form"), F.col("n").alias("_form_n"))
    rows = words.join(near, "rank", "left").join(best, "up", "left")
    enough = F.col("_form_n") >= ratio * F.col("n")
    rows = cut_lineage(rows.select(
        "rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, F.col("up")).alias("up"),
        F.when(enough, F.col("_form")).alias("form"), F.when(enough, F.col("_form_n")).alias("form_n"),
    ), "forms")
    ends = roots(rows.filter("up IS NOT NULL"))
    names = words.select(F.col("rank").alias("root"), F.col("word").alias("_root"))
    return rows.join(ends, "rank", "left").join(names, "root", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("_root", "word").alias("root")
    )
