"""Queries over the driver's tables, with the SQL each is checked against."""

from __future__ import annotations

import importlib

MODULES = ("quality", "cubes", "tables", "catalogues", "files", "scale", "paths")


def load() -> None:
    """Import every query module, which registers its queries."""
    for name in MODULES:
        importlib.import_module(f"workload.{name}")
