"""Ready-made queries over the driver tables, each with the SQL that checks it."""

from __future__ import annotations

import importlib

MODULES = ["chains", "events", "logs", "observer", "operations", "replicas", "streams"]


def load():
    """Import all query modules; returns (queries, checking SQL) by name."""
    for name in MODULES:
        importlib.import_module(f"chainlake.plans.{name}")
    from chainlake.plans.registry import QUERIES, SQL

    return QUERIES, SQL
