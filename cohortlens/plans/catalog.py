"""Import every query module so that the registry is complete."""

from __future__ import annotations

import importlib

from .registry import ORACLE, QUERIES

_MODULES = [
    "quality_queries",
    "association_queries",
    "profile_queries",
    "profile_table_queries",
    "model_queries",
    "assign_queries",
    "classify_queries",
    "text_queries",
    "io_queries",
]


def load() -> tuple[dict, dict]:
    for mod in _MODULES:
        importlib.import_module(f"{__package__}.{mod}")
    return QUERIES, ORACLE
