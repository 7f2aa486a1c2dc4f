"""Input checks and column housekeeping."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions import text as tx

TOKENIZERS = {"words": lambda c: F.regexp_count(c, F.lit(tx.WORD_PATTERN)), "ws": tx.ws_word_count}


def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Names every missing column; looks at the plan only."""
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def ensure_column(df: DataFrame, name: str, default: str = "unknown") -> DataFrame:
    """Add a constant column when it is absent."""
    return df if name in df.columns else df.withColumn(name, F.lit(default))


def require_nonempty(df: DataFrame, message: str) -> DataFrame:
    """A10: runs a job that stops at the first row found."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def clean_text_col(df: DataFrame, c: str) -> DataFrame:
    """C1."""
    return df.withColumn(c, tx.as_text(F.col(c)))


def non_blank(df: DataFrame, c: str) -> DataFrame:
    """C2."""
    return df.filter(tx.is_non_blank(F.col(c)))


def min_words(df: DataFrame, c: str, n: int, tokenizer: str = "ws") -> DataFrame:
    """C4: at least n tokens of the named tokenizer."""
    return df.filter(TOKENIZERS[tokenizer](F.col(c)) >= n)


def keep_in(df: DataFrame, c: str, values: Iterable) -> DataFrame:
    """Membership in a literal set; reaches the scan as a pushed filter."""
    return df.filter(F.col(c).isin(list(values)))


def drop_null(df: DataFrame, *cols: str) -> DataFrame:
    """C7."""
    return df.na.drop(subset=list(cols))


def project_present(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in cols if c in df.columns])


def tag(df: DataFrame, c: str, value) -> DataFrame:
    """C11."""
    return df.withColumn(c, F.lit(value))


def add_length_features(df: DataFrame, c: str) -> DataFrame:
    """Characters and white-space words."""
    return df.withColumns({"n_chars": F.length(c), "n_words": tx.ws_word_count(F.col(c))})


def add_lexical_features(df: DataFrame, c: str) -> DataFrame:
    """C20: unique words and their share; NULL share without words."""
    tokens = tx.ws_tokens(F.col(c))
    return (
        df.withColumn("_tokens", tokens)
        .withColumn("unique_words", F.size(F.array_distinct("_tokens")))
        .withColumn(
            "lexical_diversity",
            F.when(F.size("_tokens") > 0, F.col("unique_words") / F.size("_tokens")),
        )
        .drop("_tokens")
    )


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows as they pass, without a job of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def cleaning_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row with the counts before and after."""
    kept = after.agg(F.count(F.lit(1)).alias("rows_after"))
    return before.agg(F.count(F.lit(1)).alias("rows_before")).crossJoin(F.broadcast(kept))
