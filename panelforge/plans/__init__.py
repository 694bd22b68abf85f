"""Registered queries; importing the modules registers them."""

from panelforge.plans import panel_queries, season_queries, source_queries, table_queries  # noqa: F401
from panelforge.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
