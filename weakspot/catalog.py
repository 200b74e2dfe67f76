"""All registered queries of the engine and their SQL, gathered from the modules of `plans`."""

from __future__ import annotations

from .plans import basics, evidence, inference, learning, leaves, search, streams

MODULES = (basics, inference, search, leaves, learning, evidence, streams)
FLAGSHIP = "s01_weakness_frontier"


def queries() -> dict:
    return {name: q for m in MODULES for name, (q, _) in m.REGISTRY.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, (_, sql) in m.REGISTRY.items() if sql}
