"""Query of operator 1."""

from __future__ import annotations

from pyspark.sql import functions as F

from .learning import crc32_text
from .registry import query, table
from .toxicity import score_toxicity


def held_out():
    return F.coalesce(crc32_text(F.col("doc_id")) % 5 == 0, F.lit(False))


@query("op1_toxicity")
def op1_toxicity(spark, sf):
    scored = score_toxicity(
        table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "labels"), "doc_id", "toxic", ~held_out()
    )
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
