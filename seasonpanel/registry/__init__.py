"""Registered queries."""

from __future__ import annotations

import importlib

MODULES = ["season", "survey", "shapes", "models"]


def load():
    """(queries, oracles, coverage) of every registry module."""
    from . import base

    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return base.QUERIES, base.ORACLES, base.COVERS
