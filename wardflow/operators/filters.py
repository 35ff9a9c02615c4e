"""Filters and predicates (FLT-1 .. FLT-13)."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.nulls import null_if_blank
from wardflow.operators.joins import anti, semi

# The five states of a waiting list entry, one bit each.
STATE_BITS = (1, 2, 4, 8, 16)


def lookup(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key occurs in ``keys``."""
    return semi(df, keys, on)


def fold_conditions(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def search(df: DataFrame, criteria: list[tuple], off=(None,)) -> DataFrame:
    """Filter by optional criteria.

    A criterion is ``(column, operator, value)`` or ``(column, operator, value,
    sentinels)``; it is left out when the value is a sentinel, so the plan holds
    only active predicates and the scan can push them down.  Operators: ``eq``,
    ``ge``, ``le``, ``contains``, ``starts``, ``like``.
    """
    build = {
        "eq": lambda c, v: c == v,
        "ge": lambda c, v: c >= v,
        "le": lambda c, v: c <= v,
        "contains": lambda c, v: c.cast("string").contains(v),
        "starts": lambda c, v: c.startswith(v),
        "like": lambda c, v: c.like(v),
    }
    active = []
    for column, op, value, *rest in criteria:
        if value not in (rest[0] if rest else off):
            c = column if isinstance(column, Column) else F.col(column)
            active.append(build[op](c, value))
    return df.where(fold_conditions(active)) if active else df


def either_in_range(cols: list[str], lo: str, hi: str) -> Column:
    """At least one of the date texts lies in the inclusive range."""
    return reduce(or_, [F.col(c).between(lo, hi) for c in cols])


def like_any(c: Column, pattern: str, mode: str = "contains", sep: str = ",") -> Column:
    """Contains, starts with, or holds the item in a delimited list."""
    if mode == "contains":
        return c.contains(pattern)
    if mode == "starts":
        return c.startswith(pattern)
    if mode == "item":
        return F.concat(F.lit(sep), c, F.lit(sep)).contains(f"{sep}{pattern}{sep}")
    raise ValueError(f"unknown mode {mode!r}")


def in_list(c: Column, items: str | Column | None, all_values=(None, "0", ",0,"), sep: str = ",") -> Column:
    """Membership of an id in a delimited list.

    A literal list becomes ``IN`` and reaches the scan; a list column is split
    per row.  The sentinels in ``all_values`` let every row through.
    """
    if isinstance(items, Column):
        return F.array_contains(F.split(items, re.escape(sep)), c.cast("string"))
    if items in all_values:
        return F.lit(True)
    numbers = [int(i) for i in items.split(sep) if i.strip()]
    return c.isin(numbers)


def mask_filter(c: Column, mode: int) -> Column:
    """State whose bit is set in ``mode`` (1..31)."""
    return c.isin([bit for bit in STATE_BITS if bit & mode])


def exists_flags(keys: DataFrame, key: str, relations: dict[str, DataFrame]) -> DataFrame:
    """For each key one 0/1 flag per relation that holds it.

    All relations are tagged, united and aggregated together: one shuffle for
    any number of flags, and repeated keys shrink before it.
    """
    names = list(relations)
    tagged = reduce(
        DataFrame.unionByName,
        [
            df.select(key, *[F.lit(int(n == name)).alias(n) for n in names])
            for name, df in relations.items()
        ],
    )
    found = tagged.groupBy(key).agg(*[F.max(n).alias(n) for n in names])
    return keys.join(found, key, "left").fillna(0, names)


def membership(df: DataFrame, keys: DataFrame, on: str, mode: str) -> DataFrame:
    """``in``, ``out`` or ``all`` with respect to a key list."""
    if mode == "all":
        return df
    return {"in": semi, "out": anti}[mode](df, keys.where(F.col(on).isNotNull()), on)


def multi_text_search(cols: list[Column], word1: str | None, word2: str | None, mode: str) -> Column:
    """One or two words anywhere in several text columns.

    With one word missing the other decides alone; with both missing every row
    matches.
    """
    if word1 is None:
        word1, word2 = word2, None

    def anywhere(word: str) -> Column:
        return reduce(or_, [F.coalesce(c.contains(word), F.lit(False)) for c in cols])

    if word1 is None:
        return F.lit(True)
    if word2 is None:
        return anywhere(word1)
    join = and_ if mode == "and" else or_
    return join(anywhere(word1), anywhere(word2))


def code_filter(df: DataFrame, c: str, values: list, null_is_active: str | None = None) -> DataFrame:
    """Fixed codes in one column; optionally only rows not marked in another."""
    out = df.where(F.col(c).isin(values))
    return out if null_is_active is None else out.where(F.col(null_is_active).isNull())


def contact_filter(df: DataFrame, cols: list[str], mode: int) -> DataFrame:
    """0: all rows, 1: any contact column filled, 2: all of them blank."""
    if mode == 0:
        return df
    filled = reduce(or_, [null_if_blank(F.col(c)).isNotNull() for c in cols])
    return df.where(filled if mode == 1 else ~filled)
