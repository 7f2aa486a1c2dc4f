"""Lookups and joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.prompts import game_description
from ..functions.text import strip
from ..functions.vectors import cosine
from ..session import cut_lineage
from ..sizing import broadcast_if_small
from .sampling import dense_id


def attach_titles(reviews: DataFrame, titles: DataFrame, key: str = "app_id") -> DataFrame:
    """Left join; rows without a title keep NULL."""
    return reviews.join(broadcast_if_small(titles), key, "left")


def attach_labels(
    sample: DataFrame, labels: DataFrame, id_col: str = "temp_id", label_id: str = "id",
    label: str = "sentiment", position: str = "position",
) -> DataFrame:
    """Inner join on the id; of several labels for one id the last in the file counts."""
    last = labels.groupBy(F.col(label_id).alias(id_col)).agg(
        F.max_by(label, position).alias("ground_truth")
    )
    return sample.join(last.filter("ground_truth is not null"), id_col, "inner")


def attach_description(
    df: DataFrame, by_app: dict[int, str] | None = None, by_keyword: dict[str, str] | None = None,
    **default: str,
) -> DataFrame:
    """D3."""
    text = game_description(F.col("app_id"), F.col("title"), by_app, by_keyword, **default)
    return df.withColumn("description", text)


KEYWORDS_AT_ONCE = 50_000  # of one automaton


def attach_keyword_description(
    df: DataFrame, keywords: DataFrame, title: str = "title", out: str = "description", default: str | None = None
) -> DataFrame:
    """D3 for a keyword table (priority, keyword, description): the description of the first listed
    keyword that the lowered title contains, else ``default``.

    The keywords are matched all at once by an automaton that every Python process makes once, so a
    title is read once however many there are. A table above ``KEYWORDS_AT_ONCE`` rows goes in
    several automata by priority, each of bounded size; the first with a match decides. Equal
    keywords count with their least priority, blank and null ones not at all.
    """
    known = keywords.filter("priority IS NOT NULL AND trim(keyword) <> ''")
    known = known.groupBy(F.lower("keyword").alias("_keyword")).agg(F.min_by(F.struct("priority", "description"), "priority").alias("_d"))
    known = cut_lineage(dense_id(known.select("_keyword", "_d.*"), ["priority", "_keyword"], name="_place"), "keywords")
    best = F.lit(None).cast("bigint")
    for lo in range(0, known.count(), KEYWORDS_AT_ONCE):
        part = known.filter(F.col("_place").between(lo, lo + KEYWORDS_AT_ONCE - 1)).select("_place", "_keyword").collect()
        best = F.coalesce(best, _first_place({r["_keyword"]: r["_place"] for r in part})(F.lower(strip(F.coalesce(F.col(title), F.lit(""))))))
    found = df.withColumn("_place", best)
    table = broadcast_if_small(known.select("_place", F.col("description").alias("_found")))
    return found.join(table, "_place", "left").withColumn(out, F.coalesce("_found", F.lit(default))).drop("_place", "_found")


def _first_place(places: dict[str, int]):
    """Column function: the least place of the keywords in a text."""

    @F.pandas_udf("bigint")
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for keyword, place in places.items():
            automaton.add_word(keyword, place)
        automaton.make_automaton()
        for texts in batches:
            known = {t: min((place for _, place in automaton.iter(t)), default=None) for t in texts.unique()}
            yield texts.map(known).astype("Int64")

    return match


def keep_known(df: DataFrame, meta: DataFrame, key: str = "app_id") -> DataFrame:
    """Semi join with the apps that have metadata."""
    return df.join(broadcast_if_small(meta.select(key)), key, "left_semi")


def compare_contributions(a: DataFrame, b: DataFrame, key: str = "word") -> DataFrame:
    """Full outer join of two top lists; a word missing on a side counts 0."""
    return a.join(b, key, "full_outer").na.fill(0.0)


def scatter_back(df: DataFrame, part: DataFrame, id_col: str) -> DataFrame:
    """Results of a sample back onto the whole table; other rows get NULL."""
    return df.join(broadcast_if_small(part), id_col, "left")


def anchor_classify(
    df: DataFrame, vec: str, anchors: DataFrame, pos: str = "anchor_pos", neg: str = "anchor_neg"
) -> DataFrame:
    """POSITIVE when strictly nearer to the positive anchor, a tie is NEGATIVE.

    ``anchors`` is one row with two vectors (a global aggregate or literals).
    """
    joined = df.crossJoin(F.broadcast(anchors.agg(F.first(pos).alias(pos), F.first(neg).alias(neg))))
    return (
        joined.withColumn("score_pos", cosine(F.col(vec), F.col(pos)))
        .withColumn("score_neg", cosine(F.col(vec), F.col(neg)))
        .withColumn(
            "prediction",
            F.when(F.col("score_pos") > F.col("score_neg"), "POSITIVE").otherwise("NEGATIVE"),
        )
        .drop(pos, neg)
    )


def pending(df: DataFrame, done: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id is not done yet, whatever the order of either side."""
    return df.join(done.select(id_col), id_col, "left_anti")


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Union all by column name; a column absent on one side is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_methods(frames: dict[str, DataFrame], text_col: str = "generated_text") -> DataFrame:
    """One table from the per-method ones that do have the text column."""
    usable = [df.withColumn("method", F.lit(m)) for m, df in frames.items() if text_col in df.columns]
    if not usable:
        raise ValueError(f"no input has the column {text_col}")
    merged = stack(usable).withColumn(text_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    wanted = ["app_id", "title", "rating", "method", text_col]
    return merged.select(*[c for c in wanted if c in merged.columns])


def expand_methods(df: DataFrame, prompts: dict[str, Column]) -> DataFrame:
    """One row per method with its prompt and a still empty text."""
    options = F.array(*[
        F.struct(F.lit(m).alias("method"), p.alias("prompt")) for m, p in prompts.items()
    ])
    return (
        df.withColumn("_m", F.explode(options))
        .select(*df.columns, "_m.method", "_m.prompt", F.lit("").alias("generated_text"))
    )
