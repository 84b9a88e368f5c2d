"""Queries bound to the given tables."""

from __future__ import annotations

import importlib

MODULES = (
    "text_queries", "link_queries", "page_queries", "entity_queries", "store_queries", "chain_queries", "state_queries", "proof_queries",
)


def load_all():
    """Import every query module once and return (queries, oracles)."""
    from acadspark.catalog import registry

    for module in MODULES:
        importlib.import_module(f"acadspark.catalog.{module}")
    return registry.QUERIES, registry.ORACLES
