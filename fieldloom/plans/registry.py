"""Collects the registered queries of all sections."""

from __future__ import annotations

import importlib

from .bindings import ORACLES, QUERIES, Query

SECTIONS = ["joins", "profiles", "grids", "maps", "response", "columns", "completeness", "products"]


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for s in SECTIONS:
        importlib.import_module(f"{__package__}.{s}")
    return dict(QUERIES), dict(ORACLES)
