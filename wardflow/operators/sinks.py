"""Table inserts and upkeep that are written (DM-1, DM-9, and DM-2 .. DM-13 part by part)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.operators import maintenance
from wardflow.operators.joins import semi
from wardflow.operators.windows import numbered
from wardflow.sources.stores import KeyedTable, RunTable


def append_run(table: RunTable, new: DataFrame, key: str, order: list, run: int) -> None:
    """Store new rows with the next free surrogate keys, in the given order (DM-1).

    Keys go on from the runs before this one, so the same run gives the same keys.
    """
    top = table.read(before=run).agg(F.coalesce(F.max(key), F.lit(0)).alias("top")).scalar()
    keyed = numbered(new.drop(key), order, "_n").withColumn(key, F.col("_n") + top)
    table.add(keyed.drop("_n"), run)


def snapshot_run(log: RunTable, df: DataFrame, keys: DataFrame, key: str, log_type: str, as_of: Column, run: int) -> None:
    """Store copies of the named rows with time and type of the change (DM-9)."""
    log.add(maintenance.snapshot(df, keys, key, log_type, as_of), run)


def snapshot_children(log: RunTable, children: DataFrame, rows: DataFrame, key: str, keep: list[str], run: int) -> None:
    """Store the children of changed rows, each with columns ``keep`` of its row (DM-9)."""
    parents = rows.select(key, *keep)
    log.add(semi(children, parents, key).join(parents, key), run)


def stored_change(table: KeyedTable, changes: DataFrame, operator: Callable[..., DataFrame], run: int, **options) -> DataFrame:
    """Apply an operator of ``maintenance`` to a stored table, and give the table as it is then.

    The operator is called as ``operator(rows, changes, **options)`` with the rows of the touched
    parts; the other parts are not read.
    """
    table.rewrite(changes, lambda rows, chg: operator(rows, chg, **options), run)
    return table.read()
