"""All queries over the driver's tables, and their SQL."""

from __future__ import annotations

from importlib import import_module

from corpusgraph.plans.registry import QUERIES, SQL

for _name in ("selection", "combining", "analysis", "search", "documents", "indexes"):
    import_module(f"corpusgraph.plans.{_name}")

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark, folder):
    """Hybrid retrieval over the documents and the embeddings in *folder*."""
    return QUERIES["v07_hybrid"](spark, folder)
