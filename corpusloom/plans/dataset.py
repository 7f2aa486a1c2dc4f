"""Dataset build, prompt batch and training pairs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import flags, prompts, text as tx
from ..operators import dedup, guards, joins, sampling, stats
from ..session import cut_lineage
from ..sources import readers


def build_dataset(reviews: DataFrame, titles: DataFrame, order: str = "id", min_chars: int = 30) -> DataFrame:
    """Titles, NULL repair, length filter, first of equal texts per app, vote to rating.

    Titles depend on the app alone, so they are attached after the filters and the one shuffle.
    """
    texts = guards.clean_text_col(reviews, "review_text").filter(
        tx.char_length_between(F.col("review_text"), min_chars)
    )
    unique = dedup.dedup_first(texts, ["app_id", "review_text"], order, text_col="review_text")
    rated = unique.withColumn("rating", flags.to_rating(F.col("recommended")))
    return joins.attach_titles(rated, titles).select(
        order, "app_id", "title", "rating", "review_text"
    )


def build_prompt_batch(dataset: DataFrame, cap: int = 1000) -> DataFrame:
    """Up to ``cap`` prompts per app, title and rating, for both prompt methods.

    A missing app id becomes -1; a missing title becomes '' (not the word "nan").
    """
    guards.require_columns(dataset, ["app_id", "title", "rating"])
    slots = stats.prompt_counts(guards.keep_in(dataset, "rating", [3, 9]), cap)
    base = slots.select(
        F.coalesce("app_id", F.lit(-1)).alias("app_id"), tx.as_text(F.col("title")).alias("title"),
        "rating", "slot",
    )
    title, rating = F.col("title"), F.col("rating")
    description = prompts.game_description(F.col("app_id"), title)
    return joins.expand_methods(base, {
        "naive": prompts.naive_prompt(title, rating),
        "engineered": prompts.engineered_prompt(title, rating, description),
    })


def training_pairs(
    dataset: DataFrame, id_col: str = "id", lo: int = 80, hi: int = 1200, test: float = 0.1,
    seed: int = sampling.SEED, exact: bool = False,
) -> DataFrame:
    """Prompt/completion pairs of fitting reviews with a train or validation mark.

    The hash split needs no job; the exact one takes ceil(test * n) rows for validation.
    """
    guards.require_columns(dataset, ["title", "rating", "review_text"])
    rows = dataset.withColumns({
        "review_text": tx.as_text(F.col("review_text")), "title": tx.as_text(F.col("title")),
        "rating": F.col("rating").cast("int"),
    })
    rows = guards.keep_in(rows, "rating", [3, 9]).filter(
        tx.char_length_between(F.col("review_text"), lo, hi) & tx.is_non_blank(F.col("title"))
    )
    if exact:
        rows = cut_lineage(rows)  # the split looks at the rows three times
        rows = sampling.split_exact(rows, id_col, test, seed)
    else:
        rows = rows.withColumn("is_test", sampling.split_flag(id_col, test, seed))
    return rows.select(
        id_col,
        prompts.training_prompt(F.col("title"), F.col("rating")).alias("prompt"),
        tx.strip(F.col("review_text")).alias("completion"),
        F.when(F.col("is_test"), "validation").otherwise("train").alias("split"),
    )


def merge_outputs(
    spark: SparkSession, paths: dict[str, str], schema: str, text_col: str = "generated_text",
    notice=print,
) -> DataFrame:
    """I1 on files: absent files and files without the text column are skipped with a notice."""
    frames = {}
    types = dict(part.strip().split(" ", 1) for part in schema.split(","))
    for method, path in paths.items():
        try:
            columns = readers.csv_columns(spark, path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            notice(f"missing: {path}")
            continue
        if text_col not in columns:
            notice(f"no column {text_col}: {path}")
            continue
        own = ", ".join(f"`{c}` {types.get(c, 'STRING')}" for c in columns)
        frames[method] = readers.read_reviews(spark, path, own)
    return joins.merge_methods(frames, text_col)
