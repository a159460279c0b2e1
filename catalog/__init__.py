"""Every operator as a query on the driver tables, with its SQL oracle."""

from __future__ import annotations

from importlib import import_module

MODULES = ["relational", "textual", "matrices", "graphs", "files"]


def _merge(attribute: str) -> dict:
    merged = {}
    for name in MODULES:
        merged.update(getattr(import_module(f"catalog.{name}"), attribute))
    return merged


def all_queries() -> dict:
    return _merge("QUERIES")


def all_sql() -> dict:
    return _merge("SQL")
