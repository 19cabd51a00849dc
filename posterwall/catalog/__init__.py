"""Queries of every operator over the driver's tables, each with its SQL counterpart."""

from posterwall.catalog import cities, feeds, pages, robust, runs, slots, streams, texts  # noqa: F401
from posterwall.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
