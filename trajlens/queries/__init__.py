"""Every operator as a query over the shared test tables, with its SQL twin."""

from trajlens.queries import profiling, preparing, scoring, evaluating, comparing, storing  # noqa: F401
from trajlens.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
