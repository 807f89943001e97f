"""All named queries."""

from knowloom.plans import ingest, knowledge, operate, retrieve  # noqa: F401
from knowloom.plans.registry import ORACLES, QUERIES

FLAGSHIP = "hybrid_search"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
