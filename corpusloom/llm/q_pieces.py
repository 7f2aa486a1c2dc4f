"""Query of operator 2."""

from __future__ import annotations

from .pieces import default_model, encode_checked
from .registry import query, table


@query("op2_sentencepiece")
def op2_sentencepiece(spark, sf):
    """Piece ids of every whole text, and the checksum of what they decode to."""
    coded = encode_checked(table(spark, sf, "documents").select("doc_id", "text"), "text", default_model())
    return coded.select("doc_id", "n_tokens", "ids", "text_sha256").withColumnRenamed("text_sha256", "decoded_sha256")
