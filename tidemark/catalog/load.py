"""Import every query module, so that the registry is full."""

from tidemark.catalog import flows, goals, models, nested, sources, stock, streams, zones  # noqa: F401
from tidemark.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
