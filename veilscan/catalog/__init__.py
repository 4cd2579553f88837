"""Runnable queries over the driver tables, each with SQL that computes the same result."""

from __future__ import annotations


def everything():
    """(queries, sql) of all catalog modules."""
    from importlib import import_module

    from veilscan.catalog import registry

    for module in ("scanning", "matching", "records", "streams"):
        import_module(f"veilscan.catalog.{module}")
    return registry.QUERIES, registry.SQL
