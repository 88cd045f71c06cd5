"""Registry of the core queries and their oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = (*(f"wayspring.operators.{m}" for m in ("retrieval", "corpus", "quality", "answers", "sessions", "store", "integrity", "geo")), "wayspring.sources.files")


def _gather(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        found = getattr(importlib.import_module(m), name)
        clash = out.keys() & found.keys()
        if clash:
            raise ValueError(f"query names registered twice: {sorted(clash)}")
        out |= found
    return out


def queries() -> dict[str, Callable]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE")
