"""Read the physical plan: Python nodes, exchanges, scan columns and filters."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas", "PythonMapInArrow",
                "FlatMapGroupsInPandas")


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    return df._jdf.queryExecution().executedPlan().toString() if mode == "physical" else \
        df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def node_counts(df: DataFrame) -> Counter:
    """Count operator names in the executed physical plan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    names = re.findall(r"^[\s:+\-*()0-9]*([A-Z][A-Za-z]+)", text, flags=re.M)
    return Counter(names)


def python_nodes(df: DataFrame) -> int:
    c = node_counts(df)
    return sum(v for k, v in c.items() if k in PYTHON_NODES)


def exchanges(df: DataFrame) -> int:
    c = node_counts(df)
    return sum(v for k, v in c.items() if k in ("Exchange", "ShuffleExchange"))


def read_schema(df: DataFrame) -> list[str]:
    """ReadSchema of every file scan in the plan."""
    return re.findall(r"ReadSchema: (struct<[^\n]*>)", plan_text(df))


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: (\[[^\n]*\])", plan_text(df))
