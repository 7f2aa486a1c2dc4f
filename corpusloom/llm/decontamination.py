"""Operator 4: benchmark decontamination by a prefix-filtered set join, in Spark expressions only.

Every benchmark item is cut into windows of 13 words (a shorter item is one window). The tokens of a
window are ordered by how rare they are in the corpus; as a window must be contained whole, a prefix
of one token is enough: a document with the window holds its rarest word. The words of documents
meet that index in one pass. Each meeting lays the window against the document at one place; length
and position bounds come first, then all its words are compared.

The index is broadcast in blocks of measured size, one pass over the documents per block. No text
is shuffled: only rows of found windows are.

Defined cases: a null or wordless text or item has no words and no windows; repeated items and words
count once per document position; rows that share a document id share its hits; null ids are an id
of their own and a null item id is left out of lists; an empty benchmark hits nothing; other columns
are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .native_words import ascii_lower, broadcast_blocks, lookup_key, union_all, word_rows, words, words_at

WINDOW = 13


def item_index(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, window: int) -> list[DataFrame]:
    """Blocks of (_key, _item, _before, _width, _window): every window under its rarest word, which
    stands after ``_before`` others."""
    w = cut_lineage(
        items.select(F.col(item_id).alias("_item"), words(ascii_lower(F.col(item_text))).alias("_w"))
        .filter(F.size("_w") > 0).distinct(), "items",
    )
    width = F.least(F.lit(window), F.size("_w"))
    windows = w.select("_item", "_w", width.alias("_width"), F.explode(F.sequence(F.lit(1), F.size("_w") - width + 1)).alias("_s"))
    windows = cut_lineage(
        windows.select("_item", "_width", F.slice("_w", F.col("_s"), F.col("_width")).alias("_w")).distinct()
        .withColumn("_window", F.array_join("_w", " ")), "item-windows",
    )
    placed = windows.select("_item", "_width", "_window", F.posexplode("_w").alias("_before", "_word"))
    placed = placed.select("_item", "_width", "_window", "_before", lookup_key(F.col("_word")).alias("_key"))
    vocabulary = broadcast_blocks(placed.select("_key").distinct(), "_key", "item-words")
    corpus = word_rows(docs, doc_id, text).select("_key")
    counts = union_all([corpus.join(v, "_key").groupBy("_key").agg(F.count(F.lit(1)).alias("_n")) for v in vocabulary])
    rarest = Window.partitionBy("_item", "_window").orderBy(F.coalesce("_n", F.lit(0)), "_key", "_before")
    prefix = placed.join(counts, "_key", "left").withColumn("_r", F.row_number().over(rarest)).filter("_r = 1")
    return broadcast_blocks(prefix.select("_key", "_item", "_before", "_width", "_window"), "_window", "item-index")


def find_windows(docs: DataFrame, doc_id: str, text: str, index: list[DataFrame]) -> DataFrame:
    """_doc, _item, _start, _end: every verified occurrence of a window, in words of the document."""
    start = F.col("_pos") - F.col("_before")
    found = []
    for block in index:
        met = word_rows(docs, doc_id, text).join(block, "_key")
        fits = (start >= 0) & (start + F.col("_width") <= F.size("_words"))
        held = met.filter(fits & (words_at(start, F.col("_width")) == F.col("_window")))
        found.append(held.select("_doc", "_item", start.alias("_start"), (start + F.col("_width")).alias("_end")).distinct())
    return union_all(found)


def contamination(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str,
    window: int = WINDOW, share: int = 20,
) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted strings), contaminated.

    A document is contaminated if it has a hit word and at least one hit in ``share`` words.
    """
    index = item_index(docs, doc_id, text, items, item_id, item_text, window)
    hits = cut_lineage(find_windows(docs, doc_id, text, index), "windows")
    before = Window.partitionBy("_doc").orderBy("_start", "_end").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("_doc", "_start", "_end").distinct().withColumn(
        "_covered", F.coalesce(F.max("_end").over(before), F.lit(0))
    )
    hit_words = spans.groupBy("_doc").agg(
        F.sum(F.greatest(F.col("_end") - F.greatest("_start", "_covered"), F.lit(0))).cast("bigint").alias("n_hit")
    )
    found = hits.filter("_item IS NOT NULL").select("_doc", F.col("_item").cast("string").alias("_item")).distinct()
    ids = found.groupBy("_doc").agg(F.sort_array(F.collect_list("_item")).alias("item_ids"))
    per_doc = hit_words.join(ids.withColumnRenamed("_doc", "_d"), F.col("_doc").eqNullSafe(F.col("_d")), "left").drop("_d")
    counted = docs.select(F.col(doc_id).alias(doc_id), F.size(words(F.col(text))).cast("bigint").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return counted.join(per_doc, F.col(doc_id).eqNullSafe(F.col("_doc")), "left").select(
        doc_id, "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
