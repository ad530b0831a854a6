"""Helpers that look at physical plans: what a query pushes down, joins and exchanges."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def nodes(df: DataFrame) -> Counter:
    """How often each operator stands in the plan (the initial one under adaptive execution)."""
    return Counter(m[1] for m in re.finditer(r"^[\s:+\-*()\d]*([A-Z]\w+)", physical(df).split("== Initial Plan ==")[-1], re.M))


def pushed_filters(df: DataFrame) -> list[str]:
    return [f for found in re.findall(r"PushedFilters: \[([^\]]*)\]", physical(df)) for f in found.split(", ") if f]


def read_columns(df: DataFrame) -> list[set[str]]:
    """Columns of each scan."""
    return [set(re.findall(r"(\w+):", found)) for found in re.findall(r"ReadSchema: struct<([^\n]*)>", physical(df))]
