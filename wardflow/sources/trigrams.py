"""An index of three-letter pieces that tells which rows can contain a text (FLT-4, FLT-9, CQ-19).

The index holds one row for each piece and part of the table, so it does not grow with the
number of times a piece occurs in a part.  A search reads the rows of the index for the
pieces of the wanted text, opens only the parts of the table that have all of them, and
checks the text itself there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.sources.stores import KeyedTable, RunTable

SIZE = 3


def pieces(text: Column) -> Column:
    """Distinct pieces of ``SIZE`` letters; none of NULL and of shorter texts."""
    starts = F.sequence(F.lit(1), F.length(text) - SIZE + 1)
    found = F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(SIZE))))
    return F.when(F.length(text) >= SIZE, found).otherwise(F.array().cast("array<string>"))


def wanted_pieces(text: str) -> list[str]:
    return sorted({text[i : i + SIZE] for i in range(len(text) - SIZE + 1)})


class TextIndex:
    """Pieces of the text columns of a stored table, by part of the table."""

    def __init__(self, spark: SparkSession, path: str, table: KeyedTable, columns: list[str]):
        self.table, self.columns = table, columns
        schema = T.StructType().add("column", "string").add("piece", "string").add("part", "long")
        self.entries = RunTable(spark, path, schema)

    def _of(self, rows: DataFrame) -> DataFrame:
        part = self.table.part_of(F.col(self.table.by)).alias("part")
        each = [
            rows.select(F.lit(c).alias("column"), F.explode(pieces(F.col(c))).alias("piece"), part).distinct() for c in self.columns
        ]
        # rows of a piece lie together, so that a search opens few row groups
        return reduce(DataFrame.unionByName, each).repartition("piece").sortWithinPartitions("piece")

    def build(self, run: int = 0) -> None:
        self.entries.add(self._of(self.table.read()), run)

    def extend(self, changed: DataFrame, run: int) -> None:
        """Add the pieces of new and changed rows; pieces that are gone cost a look, not a wrong answer."""
        self.entries.add(self._of(changed), run)

    def parts_with(self, column: str, text: str) -> list[int] | None:
        """Parts that have all pieces of a text, at most as many as the table has; None if any part can."""
        wanted = wanted_pieces(text)
        if not wanted:
            return None
        found = self.entries.read().where((F.col("column") == column) & F.col("piece").isin(wanted))
        each = found.groupBy("part").agg(F.count_distinct("piece").alias("n")).where(F.col("n") == len(wanted))
        return sorted(r["part"] for r in each.collect())

    def search(self, text: str) -> DataFrame:
        """Rows that contain a text in any of the columns."""
        parts: set[int] | None = set()
        for c in self.columns:
            some = self.parts_with(c, text)
            parts = None if some is None or parts is None else parts | set(some)
        rows = self.table.read(None if parts is None else sorted(parts))
        return rows.where(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.col(c), F.lit(text)), F.lit(False)) for c in self.columns]))
