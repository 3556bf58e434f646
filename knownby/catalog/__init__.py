"""Registered queries over the driver's tables, with equivalent SQL."""

from importlib import import_module

from knownby.catalog.base import ORACLES, QUERIES

GROUPS = (
    "series_queries", "pit_queries", "source_queries", "panel_queries", "domain_queries", "inference_queries",
    "research_queries", "stream_queries",
)

for _name in GROUPS:
    import_module(f"knownby.catalog.{_name}")

__all__ = ["ORACLES", "QUERIES"]
