"""Query of operator 8."""

from __future__ import annotations

from .quality import judge_quality
from .registry import query, table


@query("op8_quality_rules")
def op8_quality_rules(spark, sf):
    return judge_quality(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "labels"), "doc_id", "quality")
