"""Imports every operator module, which registers its query."""

from importlib import import_module

from knownby.llm.catalog import ORACLES, QUERIES

MODULES = ("bpe", "packing", "warc", "site_style_tree", "pii", "language_crf", "substring_dedup", "order_minhash", "collision_counting", "cross_polytope", "quality_ftrl", "vantage_kmeans", "periodic_runs")

for _name in MODULES:
    import_module(f"knownby.llm.{_name}")

__all__ = ["ORACLES", "QUERIES"]
