"""Named tables, namespaces, shared intermediates and settings."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession


class ParquetTables:
    """Tables of one folder by name, opened on first use.

    A name may carry a namespace (``doc.files``); each namespace has a folder of
    its own.  Only the columns a query asks for are read.
    """

    def __init__(self, spark: SparkSession, folder: str, **namespaces: str):
        self.spark = spark
        self.folders = {"": folder, **namespaces}

    def __getitem__(self, name: str) -> DataFrame:
        space, _, table = name.rpartition(".")
        return self.spark.read.parquet(f"{self.folders[space]}/{table}.parquet")


def scan(tables: Mapping[str, DataFrame], name: str, cols: list[str]) -> DataFrame:
    """Full scan of a table with a column list (SRC-1, SRC-2)."""
    return tables[name].select(*cols)


def staged(df: DataFrame, *branches: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """Intermediate result that several branches read (SRC-3).

    The plan stays lazy: equal sub-plans are executed once through exchange
    reuse, so nothing has to be pinned in executor memory.
    """
    return [branch(df) for branch in branches]


def with_settings(df: DataFrame, settings: DataFrame, cols: list[str]) -> DataFrame:
    """Columns of the one-row settings table as scalar values (SRC-4).

    A scalar subquery fails on more than one row, so no join is involved.
    """
    return df.select("*", *[settings.select(c).scalar().alias(c) for c in cols])
