"""Labels, targets and 0/1 flags."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

TARGET_RULES = {
    "above_5": lambda c: c > 5,
    "at_least_7": lambda c: c >= 7,
    "is_9": lambda c: c == 9,
}


def to_rating(vote: Column, pos: int = 9, neg: int = 3) -> Column:
    """Vote to rating; a NULL vote stops the query."""
    return (
        F.when(vote, F.lit(pos))
        .when(~vote, F.lit(neg))
        .otherwise(F.raise_error(F.lit("vote is NULL")).cast("int"))
    )


def target(c: Column, rule: str) -> Column:
    """Binary target by one of the named rules; NULL gives 0."""
    return F.coalesce(TARGET_RULES[rule](c.cast("double")), F.lit(False)).cast("int")


def recode(c: Column, mapping: dict[str, str]) -> Column:
    """Replace listed values, keep the others."""
    return F.coalesce(F.create_map(*[F.lit(x) for x in chain(*mapping.items())])[c], c)


def equal_flag(a: Column, b: Column) -> Column:
    """1 when prediction and target agree."""
    return F.coalesce(a == b, F.lit(False)).cast("int")


def range_flag(c: Column, lo: int, hi: int) -> Column:
    """C14: 1 inside the inclusive range."""
    return F.coalesce(c.between(lo, hi), F.lit(False)).cast("int")


def overlap_flag(c: Column, threshold: float = 0.9) -> Column:
    """1 at or above the similarity threshold."""
    return F.coalesce(c >= threshold, F.lit(False)).cast("int")


def score_to_probability(score: Column) -> Column:
    """Sigmoid of a decision score."""
    return 1 / (1 + F.exp(-score))


def score_to_label(score: Column) -> Column:
    """1 from score 0 upwards."""
    return (score >= 0).cast("int")


def probability_to_label(p: Column) -> Column:
    """For a model that gives probabilities itself."""
    return (p >= 0.5).cast("int")


def outcome(y: Column, p: Column) -> Column:
    """TP, FP, TN or FN of a 0/1 label and prediction."""
    return (
        F.when((y == 1) & (p == 1), "TP")
        .when((y == 0) & (p == 1), "FP")
        .when((y == 0) & (p == 0), "TN")
        .when((y == 1) & (p == 0), "FN")
    )
