"""Registered queries of the reference's operators and their SQL."""

from __future__ import annotations

from .plans import dense_queries, frames_queries, graph_queries, map_queries, match_queries, state_queries, support_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
