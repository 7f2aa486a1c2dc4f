"""Words of whole texts as Spark expressions, and lookups of them in measured broadcast blocks.

A word is a run of ASCII letters, digits and non-ASCII characters; comparison lowers A-Z only.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from ..sizing import measure

BLOCK_BYTES = 16 << 20
# The contract's word class before its letters A-Z are lowered.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words as they stand; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def lookup_key(word: Column) -> Column:
    """Equal for words that are equal once A-Z is lowered; a verification must follow, as it also
    joins other letters' cases."""
    return F.lower(word)


def broadcast_blocks(df: DataFrame, by: str, name: str, max_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """``df`` written once and cut by a hash of ``by`` into blocks of at most about ``max_bytes``,
    each to be broadcast in a pass of its own."""
    stored = cut_lineage(df, name)
    _, size = measure(stored)
    blocks = max(1, math.ceil(size / max_bytes))
    if blocks == 1:
        return [F.broadcast(stored)]
    part = F.pmod(F.xxhash64(by), F.lit(blocks))
    return [F.broadcast(stored.filter(part == i)) for i in range(blocks)]


def word_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """_doc, _words (the whole array), _pos from 0, _key; a wordless text has one row with null _key.

    Follow it with a broadcast join on _key whose conditions compile (no higher-order functions):
    then the array is only referred to, and never copied for each of its words.
    """
    held = docs.select(F.col(doc_id).alias("_doc"), words(F.col(text)).alias("_words"))
    rows = held.select("_doc", "_words", F.posexplode_outer("_words").alias("_pos", "_word"))
    return rows.select("_doc", "_words", "_pos", lookup_key(F.col("_word")).alias("_key"))


def words_at(first: Column, count: Column) -> Column:
    """``count`` words of _words from a 0-based place, A-Z lowered, joined by one space."""
    return ascii_lower(F.array_join(F.slice("_words", F.greatest(first, F.lit(0)) + 1, count), " "))


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
