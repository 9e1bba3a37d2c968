"""Registered queries over the standard tables."""

from __future__ import annotations

import importlib

from .base import QUERIES, SQL

MODULES = ["profile", "terms", "ordered", "search", "texts", "stores", "labels", "streams", "relations", "lookups", "catalogs", "matches", "measures", "structures", "media", "extensions"]


def load():
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return QUERIES, SQL
