"""Query of operator 9."""

from __future__ import annotations

from pyspark.sql import functions as F

from .language import identify
from .learning import crc32_text
from .registry import query, table

def held_out():
    return F.coalesce(crc32_text(F.col("doc_id")) % 4 == 2, F.lit(False))


@query("op9_language_id")
def op9_language_id(spark, sf):
    found = identify(table(spark, sf, "documents"), "doc_id", "text", "lang", ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
