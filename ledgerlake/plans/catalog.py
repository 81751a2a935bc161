"""All registered queries."""

from . import governance, graphs, records, search, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
