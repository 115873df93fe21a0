"""Registered queries over the driver tables, with their SQL."""

from .registry import ORACLES, QUERIES
from . import indexes, knowledge, retrieval, upkeep  # noqa: F401  register their queries

__all__ = ["ORACLES", "QUERIES"]
