"""The library's operators applied to the benchmark tables, with the same results stated in SQL."""

from __future__ import annotations

import importlib

MODULES = ("matching", "text", "ordering", "pages", "derived", "quality", "rules", "presentation")


def load():
    """``(queries, sql)`` by name."""
    from signpost.queries.registry import ORACLES, QUERIES

    for name in MODULES:
        importlib.import_module(f"signpost.queries.{name}")
    return QUERIES, ORACLES
