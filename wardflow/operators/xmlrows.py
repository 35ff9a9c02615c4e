"""XML fragment lists to rows (XM-1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the fragment lists.
FRAGMENT_SCHEMA = "T ARRAY<STRUCT<F: ARRAY<STRING>>>"


def shred_pairs(df: DataFrame, col: str, first: str = "F1", second: str = "F2") -> DataFrame:
    """One row per ``<T>`` fragment with its first and second ``<F>`` field.

    A missing field is NULL; rows without fragments give none.
    """
    doc = F.from_xml(F.concat(F.lit("<R>"), F.col(col), F.lit("</R>")), FRAGMENT_SCHEMA)
    return (
        df.withColumn("_t", F.explode(doc["T"]))
        .withColumns({first: F.get("_t.F", F.lit(0)), second: F.get("_t.F", F.lit(1))})
        .drop("_t")
    )


def shred_lists(df: DataFrame, cols: dict[int, str], level: str = "CatLevel") -> DataFrame:
    """Fragments of several list columns, with the level of their column.

    The lists of a row are parsed as one document and come out of one explode,
    so the rows are read and parsed once.
    """
    parts = [
        F.concat(F.lit(f"<L{n}>"), F.coalesce(F.col(c), F.lit("")), F.lit(f"</L{n}>")) for n, c in cols.items()
    ]
    schema = ", ".join(f"L{n} STRUCT<{FRAGMENT_SCHEMA.replace(' ', ': ', 1)}>" for n in cols)
    doc = F.from_xml(F.concat(F.lit("<R>"), *parts, F.lit("</R>")), schema)

    def entries(n: int):
        fragments = F.transform(
            F.col("_doc")[f"L{n}"]["T"],
            lambda t: F.struct(
                F.lit(n).alias(level), F.get(t["F"], F.lit(0)).alias("F1"), F.get(t["F"], F.lit(1)).alias("F2")
            ),
        )
        return F.coalesce(fragments, F.array().cast(f"array<struct<{level}: int, F1: string, F2: string>>"))

    merged = reduce(F.concat, [entries(n) for n in cols])
    exploded = df.withColumn("_doc", doc).withColumn("_e", F.explode(merged))
    return exploded.select(*[c for c in df.columns if c not in cols.values()], "_e.*")
