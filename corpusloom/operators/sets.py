"""Exact de-duplication and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame

from corpusloom.operators import windows


def dedup_exact(df: DataFrame, cols: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """One row per key; with `order` the survivor is fixed."""
    return windows.keep_one(df, cols, order) if order else df.dropDuplicates(list(cols))


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def exclude(df: DataFrame, other: DataFrame, col: str) -> DataFrame:
    """Rows whose `col` does not occur in `other`."""
    return df.join(other.select(col).distinct(), col, "left_anti")
