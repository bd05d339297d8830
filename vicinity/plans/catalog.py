"""Importing this module registers every query."""

from __future__ import annotations

from . import queries_deals, queries_grid, queries_scores, queries_search, queries_sites, queries_text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
