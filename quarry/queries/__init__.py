"""Registered queries with their SQL."""

from quarry.queries import plans, profiles, tables  # noqa: F401 - importing registers
from quarry.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
