"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, array: str | Column, *keep: str | Column, present: str) -> DataFrame:
    """One row per struct of ``array``; ``present`` is a field that is never null in a real element.

    The outer form with a filter on top: the plain form makes the optimizer derive
    ``size(array) > 0`` and push it below, which repeats the whole expression that builds
    the array (once per layer of projections).
    """
    return df.select(*keep, F.inline_outer(array)).filter(F.col(present).isNotNull())


def unnest_values(df: DataFrame, array: str | Column, name: str, *keep: str | Column) -> DataFrame:
    """One row per value of ``array``, nulls left out."""
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside a lambda: body(value)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
