"""All queries of the operators."""

from . import (  # noqa: F401
    q_decontamination, q_hard_negatives, q_language, q_licenses, q_near_dedup, q_packing, q_pieces, q_private_data, q_quality, q_sharding,
    q_spelling, q_substring_dedup, q_toxicity,
)
from .registry import ORACLES, QUERIES  # noqa: F401
