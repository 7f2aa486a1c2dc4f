"""Query of operator 12."""

from __future__ import annotations

from .packing import pack
from .registry import query, table


@query("op12_packing")
def op12_packing(spark, sf):
    return pack(table(spark, sf, "documents"), "doc_id", "text", with_ids=False)
