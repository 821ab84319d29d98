"""All queries of the engine's own operators."""

from engram.plans import catalogue, graph_queries, memory_queries, session_queries, text_queries  # noqa: F401
from engram.plans.base import ORACLE, QUERIES
from engram.plans.catalogue import flagship

__all__ = ["ORACLE", "QUERIES", "flagship"]
