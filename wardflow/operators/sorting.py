"""Sort, limit and queue heads (SL-1 .. SL-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ordered(keys: list) -> list[Column]:
    """``"col"`` ascending, ``"-col"`` descending, NULL always lowest."""
    out = []
    for k in keys:
        if isinstance(k, Column):
            out.append(k)
        elif k.startswith("-"):
            out.append(F.col(k[1:]).desc_nulls_last())
        else:
            out.append(F.col(k).asc_nulls_first())
    return out


def sorted_by(df: DataFrame, keys: list) -> DataFrame:
    return df.orderBy(*_ordered(keys))


def top_n(df: DataFrame, keys: list, n: int | None) -> DataFrame:
    """First ``n`` rows of an order; ``None`` means all."""
    out = sorted_by(df, keys)
    return out if n is None else out.limit(n)


def queue_head(df: DataFrame, keys: list) -> DataFrame:
    """The one row that is next."""
    return top_n(df, keys, 1)


def failed_first(status: Column, from_code: int = 3) -> Column:
    """Sort key that puts failed deliveries first: NULL from ``from_code`` on."""
    state = F.coalesce(status, F.lit(0))
    return F.when(state < from_code, state)


def priority_sort(df: DataFrame, priority: Column, then: list) -> DataFrame:
    """Sort by a computed priority, NULL first, then by further keys."""
    return df.orderBy(priority.asc_nulls_first(), *_ordered(then))


def mode_sort(df: DataFrame, mode, key_sets: dict) -> DataFrame:
    """Sort by the key list that belongs to a mode."""
    return sorted_by(df, key_sets[mode])


def unordered(df: DataFrame) -> DataFrame:
    """A view's inner sort promises no order, so none is made."""
    return df
