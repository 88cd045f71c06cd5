"""Checks on physical plans, used by tests: what is scanned, shuffled, broadcast."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df: DataFrame) -> dict[str, int]:
    """Counts of exchanges, broadcasts, Python stages and nested-loop joins."""
    plan = physical(df)
    names = ("Exchange hashpartitioning", "Exchange rangepartitioning", "BroadcastExchange", "CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "MapInPandas", "BatchEvalPython")
    return {n: len(re.findall(re.escape(n), plan)) for n in names}


def read_columns(df: DataFrame) -> list[set[str]]:
    """The columns each scan reads."""
    return [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<(.*?)>(?:\n|$)", physical(df))]
