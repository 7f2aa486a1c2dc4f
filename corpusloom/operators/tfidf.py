"""TF-IDF as relations, contributions and top features.

Rows are (doc_id, term, weight). Texts are cut into terms where they are read and are never
shuffled. Grams are numbers while they are counted: the tokens of an Arrow batch are encoded once, a
bigram is a pair of codes, and only distinct grams become strings. A text is one row, so its weights are
ready in the pass that reads it; only texts that share their id meet in a shuffle. The vocabulary has at
most ``max_features`` rows and is broadcast if its bytes are few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from ..session import cut_lineage, narrow_batches
from ..sizing import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS, broadcast_if_small, measure, spread

CHUNK_TOKENS = 1 << 18  # of the texts that are counted together; one text may have more


def gram_array(c: Column, n_max: int = 2) -> Column:
    """All 1..n_max-grams of an array of term tokens."""
    return F.concat(*[tx.ngrams(c, n) for n in range(1, n_max + 1)])


def term_counts(df: DataFrame, id_col: str, text_col: str, n_max: int = 2) -> DataFrame:
    """(id, term, tf)."""
    return _grams(df, id_col, text_col, n_max).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def _grams(df: DataFrame, id_col: str, text_col: str, n_max: int) -> DataFrame:
    tokens = df.select(id_col, tx.term_tokens(F.col(text_col)).alias("_t"))
    return tokens.select(id_col, F.explode(gram_array(F.col("_t"), n_max)).alias("term"))


def _text_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``CHUNK_TOKENS`` tokens (column ``_t``) at most, or one row."""
    for batch in batches:
        sizes = batch.column("_t").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, lo = np.cumsum(sizes), 0
        while lo < batch.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + CHUNK_TOKENS, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _counted(tokens: pa.ListArray, n_max: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Per length of gram: its distinct grams, and (row, gram, count) for the grams of each row."""
    sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = tokens.flatten().dictionary_encode()
    codes, names = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary.cast(pa.string())
    rows, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(codes))
    left = np.repeat(np.cumsum(sizes), sizes) - place  # tokens from here to the row's end
    grams, code = names, codes
    for n in range(1, n_max + 1):
        if n > 1:
            at = np.flatnonzero(left >= n)
            if not len(at):
                return
            # ``code`` stands at the places that begin a gram of n - 1 tokens.
            found, code_at = np.unique(code[np.searchsorted(place, at)] * len(names) + codes[at + n - 1], return_inverse=True)
            grams = pc.binary_join_element_wise(grams.take(pa.array(found // len(names))), names.take(pa.array(found % len(names))), " ")
            code, place = code_at, at
        if not len(code):
            return
        pairs, counts = np.unique(rows[place] * len(grams) + code, return_counts=True)
        yield grams, pairs // len(grams), pairs % len(grams), counts


def _distinct_by_row(tokens: pa.ListArray, n_max: int) -> np.ndarray:
    """Number of distinct grams per row and length: a gram is one number with its row in front, sorted and counted."""
    sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = tokens.flatten().dictionary_encode()
    codes, width = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(words.dictionary), 1)
    rows, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(codes))
    left = np.repeat(np.cumsum(sizes), sizes) - place  # tokens from here to the row's end
    held = np.zeros((len(sizes), n_max), np.int32)
    key, most = rows, len(sizes)  # keys are below ``most``
    for n in range(1, n_max + 1):
        kept = left[place] >= n
        place, key = place[kept], key[kept]
        if most * width >= 1 << 62:
            found, key = np.unique(key, return_inverse=True)
            most = len(found)
        key, most = key * width + codes[place + n - 1], most * width
        if most == len(sizes) * width**n:
            found = np.sort(key)
            row = found[np.diff(found, prepend=-1) > 0] // width**n
        else:
            row = rows[place[np.unique(key, return_index=True)[1]]]
        held[:, n - 1] = np.bincount(row, minlength=len(sizes))
    return held


def distinct_grams(tokens: Column, n_max: int) -> Column:
    """Number of distinct grams of each length from 1 to n_max of an array of tokens without spaces."""

    @F.arrow_udf("array<int>")
    def distinct(column: pa.Array) -> pa.Array:
        chunks = _text_chunks([pa.RecordBatch.from_arrays([column], ["_t"])])
        held = np.concatenate([np.zeros((0, n_max), np.int32), *(_distinct_by_row(c.column(0), n_max) for c in chunks)])
        return pa.ListArray.from_arrays(pa.array(np.arange(0, held.size + 1, n_max, dtype=np.int32)), pa.array(held.ravel()))

    return distinct(tokens)


def term_totals(df: DataFrame, text_col: str, n_max: int = 2) -> DataFrame:
    """(term, df, total): documents holding the term and its occurrences.

    Both come from one pass that adds up inside each task first; no document is shuffled.
    """
    def totals(batches):
        for chunk in _text_chunks(batches):
            for grams, _, gram, counts in _counted(chunk.column("_t"), n_max):
                held = np.bincount(gram, minlength=len(grams))
                total = np.bincount(gram, counts, len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([grams, pa.array(held), pa.array(total)], ["term", "df", "total"])

    narrow_batches(df.sparkSession)
    tokens = spread(df.select(text_col)).select(tx.term_tokens(F.col(text_col)).alias("_t"))
    found = tokens.mapInArrow(totals, "term STRING, df BIGINT, total BIGINT")
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def vocabulary(
    totals: DataFrame, n_docs: DataFrame, min_df: int = 2, max_features: int = 50_000
) -> DataFrame:
    """(term, df, total, idf): terms in at least min_df documents, the most frequent first,
    ties by term. ``n_docs`` is one row with the number of documents, empty ones included.

    The number of terms per total gives the total that is still needed; only terms from there
    on, the vocabulary and the ties at its end, meet in the final sort.
    """
    terms = totals.filter(F.col("df") >= min_df)
    per_total = terms.groupBy("total").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(
        Window.orderBy(F.desc("total")).rowsBetween(Window.unboundedPreceding, 0)
    )
    cut = (
        per_total.withColumn("_upto", upto)
        .filter(F.col("_upto") - F.col("_n") < max_features)
        .agg(F.min("total").alias("_cut"))
    )
    return (
        terms.crossJoin(F.broadcast(cut))
        .filter(F.col("total") >= F.col("_cut"))
        .orderBy(F.desc("total"), "term")
        .limit(max_features)
        .crossJoin(F.broadcast(n_docs))
        .select(
            "term", "df", "total",
            (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"),
        )
    )


def tfidf(
    df: DataFrame, id_col: str, text_col: str, n_max: int = 2, min_df: int = 2,
    max_features: int = 50_000,
) -> DataFrame:
    """H4: tf * (ln((1 + n) / (1 + df)) + 1), each document scaled to unit length."""
    n_docs = df.agg(F.count(F.lit(1)).alias("n_docs"))
    totals = cut_lineage(term_totals(df, text_col, n_max).filter(F.col("df") >= min_df), "totals")
    vocab = cut_lineage(vocabulary(totals, n_docs, min_df, max_features), "vocabulary")
    return weigh_texts(df, vocab, id_col, text_col, n_max)


def weigh_texts(
    df: DataFrame, vocab: DataFrame, id_col: str, text_col: str, n_max: int = 2
) -> DataFrame:
    """Weights of the vocabulary's terms in each text, for any documents. ``vocab`` is a written
    table: it is measured for the broadcast.

    Rows that share an id, or have none, are one document: these few are counted by row and added up.
    """
    rows, size = measure(vocab.select("term", "idf"))
    known = vocab.select("term", "idf").toArrow() if rows <= MAX_BROADCAST_ROWS and size <= MAX_BROADCAST_BYTES else None
    if known is None or known["term"].null_count or pc.count_distinct(known["term"]).as_py() < len(known):
        counts = _grams(spread(df), id_col, text_col, n_max).join(vocab.select("term", "idf"), "term").groupBy(id_col, "term", "idf")
        return _unit(counts.agg(F.count(F.lit(1)).alias("tf")), id_col)
    shared = df.sparkSession.sparkContext.broadcast((known["term"].combine_chunks(), known["idf"].to_numpy()))
    ids = df.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_id")
    ids = cut_lineage(ids, "repeated-ids")
    texts = df.select(id_col, text_col)
    if ids.isEmpty():
        return _weights_by_row(texts, id_col, text_col, n_max, shared).select(id_col, "term", "weight")
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    ids = broadcast_if_small(ids)
    several = _weights_by_row(texts.join(ids, same, "left_semi"), id_col, text_col, n_max, shared).groupBy(id_col, "term", "idf")
    single = _weights_by_row(texts.join(ids, same, "left_anti"), id_col, text_col, n_max, shared).select(id_col, "term", "weight")
    return single.unionByName(_unit(several.agg(F.sum("tf").alias("tf")), id_col))


def _weights_by_row(df: DataFrame, id_col: str, text_col: str, n_max: int, shared) -> DataFrame:
    """(id, term, idf, tf, weight) of the known terms, each row a document of its own."""

    def weights(batches):
        terms, idf = shared.value
        for chunk in _text_chunks(batches):
            parts = []
            for grams, row, gram, counts in _counted(chunk.column("_t"), n_max):
                term = pc.index_in(grams, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)[gram]
                kept = term >= 0
                parts.append((row[kept], term[kept], counts[kept]))
            if not parts:
                continue
            row, term, tf = (np.concatenate(x) for x in zip(*parts))
            w = tf * idf[term]
            norm = np.sqrt(np.bincount(row, w * w, chunk.num_rows))
            yield pa.RecordBatch.from_arrays(
                [chunk.column(0).take(pa.array(row)), terms.take(pa.array(term)), pa.array(idf[term]), pa.array(tf), pa.array(w / norm[row])],
                [id_col, "term", "idf", "tf", "weight"],
            )

    narrow_batches(df.sparkSession)
    tokens = spread(df).select(id_col, tx.term_tokens(F.col(text_col)).alias("_t"))
    return tokens.mapInArrow(weights, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, term STRING, idf DOUBLE, tf BIGINT, weight DOUBLE")


def weigh(counts: DataFrame, vocab: DataFrame, id_col: str) -> DataFrame:
    """Weights of known terms from ready counts, so a vocabulary can be applied to other documents."""
    return _unit(counts.join(broadcast_if_small(vocab.select("term", "idf")), "term"), id_col)


def _unit(counts: DataFrame, id_col: str) -> DataFrame:
    raw = counts.withColumn("_w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "term", (F.col("_w") / norm).alias("weight"))


def linear_score(
    docs: DataFrame, weights: DataFrame, coefs: DataFrame, id_col: str, intercept: float = 0.0
) -> DataFrame:
    """H6: sum of weight * coefficient plus the intercept; a document without terms gets it alone."""
    part = (
        weights.join(broadcast_if_small(coefs), "term")
        .groupBy(id_col)
        .agg(F.sum(F.col("weight") * F.col("coef")).alias("_s"))
    )
    return docs.join(part, id_col, "left").withColumn(
        "score", F.coalesce("_s", F.lit(0.0)) + intercept
    ).drop("_s")


def contributions(
    weights: DataFrame, coefs: DataFrame, outcomes: DataFrame, id_col: str
) -> DataFrame:
    """(outcome, word, contribution) summed over the documents of each outcome."""
    return (
        weights.join(broadcast_if_small(coefs), "term")
        .join(outcomes.select(id_col, "outcome"), id_col)
        .groupBy("outcome", F.col("term").alias("word"))
        .agg(F.sum(F.col("weight") * F.col("coef")).alias("contribution"))
    )


def discriminant_table(contrib: DataFrame, kind: str, n: int = 10) -> DataFrame:
    """The n words of one outcome with the largest absolute contribution."""
    return (
        contrib.filter(F.col("outcome") == kind)
        .orderBy(F.abs("contribution").desc(), "word")
        .limit(n)
        .select("word", F.col("contribution").alias(f"contribution_{kind.lower()}"))
    )


def top_coefs(coefs: DataFrame, n: int = 20) -> DataFrame:
    """n largest and n smallest coefficients."""
    high = coefs.orderBy(F.desc("coef"), "term").limit(n).withColumn("side", F.lit("top"))
    low = coefs.orderBy(F.asc("coef"), "term").limit(n).withColumn("side", F.lit("bottom"))
    return high.unionByName(low)


def signed_top(df: DataFrame, c: str, sign: int, n: int = 10, key: str = "word") -> DataFrame:
    """values of one sign, farthest from 0 first."""
    chosen = F.col(c) > 0 if sign > 0 else F.col(c) < 0
    return df.filter(chosen).orderBy(F.abs(c).desc(), key).limit(n)


def sort_by_size(df: DataFrame, c: str, absolute: bool = False, key: str = "word") -> DataFrame:
    """F11."""
    return df.orderBy((F.abs(c) if absolute else F.col(c)).desc(), key)
