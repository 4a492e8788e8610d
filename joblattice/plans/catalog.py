"""All registered queries."""

from joblattice.plans import browse, columns, landed, streams, upkeep  # noqa: F401
from joblattice.plans.registry import QUERIES

__all__ = ["QUERIES"]
