"""Prompt and training-pair expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from . import fixed_texts as T
from .text import first_keyword, strip


def fill(template: str, **values: Column) -> Column:
    """The template as one concat of its literal parts and the given columns."""
    parts = re.split(r"\{(" + "|".join(values) + r")\}", template)
    pieces = [
        values[part].cast("string") if i % 2 else F.lit(part)
        for i, part in enumerate(parts)
        if i % 2 or part
    ]
    return F.concat(*pieces)


def naive_prompt(title: Column, rating: Column) -> Column:
    """G12."""
    return fill(T.NAIVE_PROMPT, title=title, rating=rating)


def engineered_prompt(title: Column, rating: Column, description: Column) -> Column:
    """The balance of liked and disliked points turns at rating 7."""
    points = F.when(rating >= 7, T.POINTS_MOSTLY_LIKED).otherwise(T.POINTS_MOSTLY_DISLIKED)
    return fill(
        T.ENGINEERED_PROMPT, title=title, rating=rating, description=description, points=points
    )


def training_prompt(title: Column, rating: Column) -> Column:
    """Positive from rating 7."""
    sentiment = F.when(rating >= 7, "positive").otherwise("negative")
    return fill(T.TRAINING_PROMPT, title=title, rating=rating, sentiment=sentiment)


def game_description(
    app_id: Column,
    title: Column,
    by_app: dict[int, str] | None = None,
    by_keyword: dict[str, str] | None = None,
    default: str = T.DEFAULT_DESCRIPTION,
) -> Column:
    """D3: by app id, else by the first keyword found in the title, else the default.

    Both tables are code-sized dictionaries, so they become CASE branches and no join is planned.
    """
    by_app = T.DESCRIPTION_BY_APP if by_app is None else by_app
    if by_keyword is None:
        by_keyword = {k: T.DESCRIPTION_BY_APP[a] for k, a in T.APP_BY_TITLE_KEYWORD.items()}
    lowered = F.lower(strip(F.coalesce(title, F.lit(""))))
    fallback = first_keyword(lowered, by_keyword, F.lit(default))
    for known, text in by_app.items():
        fallback = F.when(app_id == known, F.lit(text)).otherwise(fallback)
    return fallback
