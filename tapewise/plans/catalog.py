"""All registered queries."""

from tapewise.plans import model_queries, panel_queries, signal_queries, text_queries  # noqa: F401
from tapewise.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
