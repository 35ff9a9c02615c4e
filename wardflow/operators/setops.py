"""Set operations (SO-1 .. SO-3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_distinct(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs).distinct()


def union_levels(levels: dict[int, DataFrame], name: str = "CatLevel") -> DataFrame:
    """All rows of several branches, marked with their level.

    Columns a branch lacks are NULL.
    """
    marked = [df.select(F.lit(level).alias(name), "*") for level, df in levels.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def with_totals(detail: DataFrame, totals: DataFrame) -> DataFrame:
    """Detail rows plus totals rows; each side lacks the other's columns."""
    return detail.unionByName(totals, allowMissingColumns=True)
