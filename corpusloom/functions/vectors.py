"""Vector expressions on ARRAY columns (H2, H3), in doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """H2: unit length; a zero vector stays as it is."""
    norm = F.aggregate(
        v,
        F.lit(0.0),
        lambda acc, x: acc + x.cast("double") * x.cast("double"),
        lambda acc: F.sqrt(acc),
    )
    return F.transform(
        F.arrays_zip(v.alias("x"), F.array_repeat(norm, F.size(v)).alias("n")),
        lambda p: F.when(p["n"] > 0, p["x"].cast("double") / p["n"]).otherwise(p["x"].cast("double")),
    )


def cosine(a: Column, b: Column) -> Column:
    """H3: cosine similarity, 0 when a side is a zero vector."""
    norms = l2_norm(a) * l2_norm(b)
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))
