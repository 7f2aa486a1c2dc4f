"""Query of operator 5."""

from __future__ import annotations

from pyspark.sql import functions as F

from .private_data import sanitise
from .registry import query, table


@query("op5_private_data")
def op5_private_data(spark, sf):
    found = sanitise(table(spark, sf, "documents"), "text", ["doc_id"], with_text=False)
    base = F.sha2(F.col("base_spans").cast("binary"), 256)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", base.alias("base_sha256"), "spans")
