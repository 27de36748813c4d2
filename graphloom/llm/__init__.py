"""Operators for preparing training data, and their queries.

Nothing outside this package imports it.
"""

from __future__ import annotations

from importlib import import_module

MODULES = ("components", "markup", "mixing", "packing", "repetition", "scan_repair", "sentence_bounds", "similar")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out.update(getattr(import_module(f"graphloom.llm.{module}"), name))
    return out


def queries() -> dict:
    """Query name to callable(spark, sf_dir)."""
    return _merged("QUERIES")


def oracle_sql() -> dict:
    """Query name to SQL, where SQL can express the query."""
    return _merged("SQL")
