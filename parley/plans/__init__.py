"""Registered queries: importing this package fills the registry."""

from parley.plans import oracle_metrics  # noqa: F401  (CTEs first)
from parley.plans import q_scores, q_text  # noqa: F401  (also define shared CTEs)
from parley.plans import q_io, q_profile, q_sentiment, q_shape, q_stream  # noqa: F401
from parley.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
