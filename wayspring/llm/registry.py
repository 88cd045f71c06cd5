"""Queries of the training-data operators."""

from __future__ import annotations

import importlib

MODULES = ("canonical", "qa_defects", "history_dedup", "pii", "chunks", "conversations", "token_ids", "containers", "sentences")


def _gather(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"wayspring.llm.{m}"), name)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE")
