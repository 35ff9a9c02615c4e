"""Joins (JN-1 .. JN-12).

No join carries a hint: the size-checked automatic broadcast and the skew
handling of adaptive execution apply.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.text import match_key, to_arabic


def inner(left_df: DataFrame, right_df: DataFrame, on) -> DataFrame:
    return left_df.join(right_df, on, "inner")


def left(left_df: DataFrame, right_df: DataFrame, on) -> DataFrame:
    return left_df.join(right_df, on, "left")


def star(fact: DataFrame, dims: list[tuple]) -> DataFrame:
    """Chain of joins ``(dimension, on, how)`` around one fact table."""
    return reduce(lambda df, dim: df.join(dim[0], dim[1], dim[2]), dims, fact)


def unique_keys(keys: DataFrame, on) -> DataFrame:
    """Each key once.

    Semi and anti joins can split a hot key of their left side only, so repeated
    keys on the right are combined on the map side first.  A shuffle join uses the
    same partitioning; where the keys are few enough to be broadcast, combining
    them is one small shuffle more.
    """
    cols = [on] if isinstance(on, str) else list(on)
    return keys.select(*cols).distinct()


def dim_left_join(dim: DataFrame, facts: DataFrame, on: str) -> DataFrame:
    """``dim LEFT JOIN facts`` for facts that may pile up on one key.

    A left join can neither split nor broadcast around a hot key of its right
    side.  As an inner join led by the facts it can, and the dimension rows
    without facts are added.
    """
    matched = facts.join(dim, on, "inner")
    lonely = anti(dim, facts, on)
    return matched.unionByName(lonely, allowMissingColumns=True)


def left_join_where(left_df: DataFrame, right_df: DataFrame, on: str, cond: Column) -> DataFrame:
    """Left join whose right side is restricted first; no left row is lost."""
    return dim_left_join(left_df, right_df.where(cond), on)


def semi(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Rows with a partner among the keys."""
    return df.join(unique_keys(keys, on), on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Rows without a partner (``LEFT JOIN ... IS NULL``)."""
    return df.join(unique_keys(keys, on), on, "left_anti")


def not_in(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """``NOT IN`` with its NULL rules.

    One NULL among the keys empties the result, a NULL in ``df`` matches only an
    empty key list.  Written as an equi anti join plus two scalar subqueries, so
    it never needs the key list on one machine.
    """
    n_keys = keys.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_nulls = keys.agg(F.count(F.when(F.col(on).isNull(), 1)).alias("n")).scalar()
    rest = anti(df, keys, on)
    return rest.where((n_keys == 0) | ((n_nulls == 0) & F.col(on).isNotNull()))


def split_rows(df: DataFrame, col: str, sep: str = ",", out: str = "Item") -> DataFrame:
    """One row per non-blank item of a delimited list column."""
    items = F.explode(F.split(F.col(col), re.escape(sep), -1))
    return df.withColumn(out, items).withColumn(out, F.trim(out)).where(F.col(out) != "")


def with_calendar(
    df: DataFrame, calendar: DataFrame, col: str, role: str, on: str = "MiladiDate", how: str = "left"
) -> DataFrame:
    """Calendar columns for one date column, prefixed with the role name."""
    days = calendar.select(*[F.col(c).alias(f"{role}_{c}") for c in calendar.columns])
    key = F.col(col).cast("date") if on == "MiladiDate" else F.col(col)
    return df.join(days, key == F.col(f"{role}_{on}"), how)


def join_by_link(a: DataFrame, links: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """Pair rows of two tables that share no key through a link table."""
    return links.join(a, key_a, "inner").join(b, key_b, "inner")


def match_entities(a: DataFrame, b: DataFrame, parts_a: list[Column], parts_b: list[Column]) -> DataFrame:
    """Join on a normalised composite key: letters unified, blanks removed."""
    left_side = a.withColumn("_key", to_arabic(match_key(*parts_a)))
    right_side = b.withColumn("_key", to_arabic(match_key(*parts_b)))
    return left_side.join(right_side, "_key", "inner").drop("_key")


def insert_filter(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """New rows whose key the old table lacks; NULL keys of ``old`` are ignored."""
    known = unique_keys(old.where(F.col(key).isNotNull()), key)
    return new.join(known, key, "left_anti")


def orphans(relations: dict[str, tuple[DataFrame, DataFrame, str, str]]) -> DataFrame:
    """Count of child rows without parent, one row per relation.

    A relation is ``(child, parent, foreign key, primary key)``; NULL foreign
    keys are no orphans.
    """
    counts = []
    for name, (child, parent, fk, pk) in relations.items():
        fks = child.select(F.col(fk).alias("_k")).where(F.col("_k").isNotNull())
        lost = fks.join(parent.select(F.col(pk).alias("_k")), "_k", "left_anti")
        counts.append(
            lost.agg(F.count(F.lit(1)).alias("orphans")).select(
                F.lit(name).alias("relation"), "orphans"
            )
        )
    return reduce(DataFrame.unionByName, counts)
