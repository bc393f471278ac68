"""Named queries over the test tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import importlib

MODULES = ["text", "relational", "topics", "similarity", "clusters"]


def load():
    """Import every catalog module and return (queries, oracles)."""
    for name in MODULES:
        importlib.import_module(f"topicloom.catalog.{name}")
    from topicloom.catalog.base import ORACLES, QUERIES

    return QUERIES, ORACLES
