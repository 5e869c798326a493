"""All registered queries."""

from stockloom.plans import q_blocks, q_facts, q_features, q_market, q_models, q_outlets, q_quality, q_storage, q_temporal  # noqa: F401
from stockloom.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
