"""Column expressions are built once per Spark context and used in every plan.

An expression holds no data and belongs to no DataFrame, but building a large one takes
thousands of calls to the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame

_MADE: dict[tuple, object] = {}


def reused(key: tuple, make: Callable):
    """``key`` holds all that the expression depends on; a context is told apart by its application."""
    full = (SparkContext.getOrCreate().applicationId, *key)
    if full not in _MADE:
        _MADE[full] = make()
    return _MADE[full]


class Steps:
    """Records derived columns in order, to be added to any DataFrame that has their inputs."""

    def __init__(self):
        self.items: list[dict[str, Column]] = []

    def withColumn(self, name: str, col: Column) -> Steps:
        return self.withColumns({name: col})

    def withColumns(self, cols: dict[str, Column]) -> Steps:
        self.items.append(cols)
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        for cols in self.items:
            df = df.withColumns(cols)
        return df.drop(*{c for cols in self.items for c in cols if c.startswith("_")})
