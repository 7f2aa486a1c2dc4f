"""The operators run over the driver's tables."""

from . import flow_queries, join_queries, model_queries, stats_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
