"""Aggregations (AG-1 .. AG-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.numbers import cut
from wardflow.operators.windows import in_ranges

# Seeds of the record number and the text limit of a report cell.
BRANCH_STEP = 100_000_000
YEAR_STEP = 1_000_000
FIRST_NUMBER = 1000


def row_count(df: DataFrame, name: str = "Number") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def count_where(df: DataFrame, cond: Column, name: str = "RecordCount") -> DataFrame:
    return df.where(cond).agg(F.count(F.lit(1)).alias(name))


def next_key(df: DataFrame, key: str, branches: DataFrame | None = None, branch: str = "siBranch", year_code: int = 0) -> DataFrame:
    """Next free number, for the whole table or for each branch.

    An empty branch starts at its own seed of branch and year.
    """
    if branches is None:
        top = F.coalesce(F.max(F.col(key).cast("bigint")), F.lit(FIRST_NUMBER).cast("bigint"))
        return df.agg((top + 1).alias("NewID"))
    used = df.groupBy(branch).agg(F.max(F.col(key).cast("bigint")).alias("_top"))
    seed = F.col(branch).cast("bigint") * BRANCH_STEP + F.lit(year_code).cast("bigint") * YEAR_STEP
    return branches.select(branch).join(used, branch, "left").select(
        branch, (F.coalesce("_top", seed) + 1).alias("NewID")
    )


def sum_by(df: DataFrame, keys: list[str], cols: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in cols.items()])


def has_all(df: DataFrame, key: str, code: str, codes: list) -> DataFrame:
    """Keys that hold every requested code.

    The set per key never exceeds the number of requested codes.
    """
    wanted = list(dict.fromkeys(codes))
    return (
        df.where(F.col(code).isin(wanted))
        .groupBy(key)
        .agg(F.size(F.collect_set(code)).alias("_n"))
        .where(F.col("_n") == len(wanted))
        .select(key)
    )


def having_sum(df: DataFrame, key: str, col: str, only_positive: bool, name: str = "RemainPay") -> DataFrame:
    """Sum per key, NULL counted as 0; optionally only sums above 0."""
    sums = df.groupBy(key).agg(F.sum(F.coalesce(F.col(col), F.lit(0))).alias(name))
    return sums.where(F.col(name) > 0) if only_positive else sums


def distinct_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


def name_list(df: DataFrame, key: str, col: str, sep: str = ", ", name: str = "List") -> DataFrame:
    """Distinct names of a key, sorted and joined; NULL when there are none.

    Names repeat a lot, so pairs are made distinct before they are collected.
    """
    pairs = df.select(key, col).distinct()
    joined = F.array_join(F.sort_array(F.collect_set(col)), sep)
    return pairs.groupBy(key).agg(F.nullif(joined, F.lit("")).alias(name))


def concat_ordered(
    df: DataFrame,
    key: str,
    value: Column,
    order: list[str],
    sep: str,
    width: int | None = None,
    limit: int | None = None,
    name: str = "List",
) -> DataFrame:
    """Values of a key in order, joined; ``limit`` cuts the text at so many characters.

    Blank values are skipped, one NULL makes the text of its key NULL.  Rows are
    cut into ranges of key and order, so a huge key spreads over several ranges;
    each range joins its own part of a key, and only these texts meet.
    """
    v = value if width is None else cut(value, width)
    rows = df.select(key, v.cast("string").alias("_v"), *order)
    poisoned = rows.groupBy(key).agg(F.max(F.col("_v").isNull()).alias("_null"))
    ranged = in_ranges(rows.where(F.col("_v") != ""), [key, *order, "_v"])
    item = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], "_v")
    pieces = ranged.groupBy(key, "_range").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_v"]), sep).alias("_part")
    )
    whole = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("_range", "_part"))), lambda x: x["_part"]), sep
    )
    texts = pieces.groupBy(key).agg((whole if limit is None else F.left(whole, F.lit(limit))).alias("_text"))
    return poisoned.join(texts, key, "left").select(
        key,
        F.when(~F.col("_null"), F.coalesce("_text", F.lit(""))).alias(name),
    )


def period_pivot(
    df: DataFrame,
    keys: list[str],
    date_col: str,
    today: str,
    starts: list[str],
    keep_outside: bool = True,
    prefix: str = "Zone",
) -> DataFrame:
    """Rows per key and period, one column per period start (newest first).

    The first period is closed at ``today``, the others are half open.  A cell
    without rows is NULL.  Keys with no date in any period stay, with NULLs
    only, unless ``keep_outside`` is off; then the range is also pushed to the
    scan.  One aggregation with conditional sums: one shuffle of partial sums.
    """
    d = F.col(date_col)
    if not keep_outside:
        df = df.where(d.between(starts[-1], today))
    cells = []
    for i, start in enumerate(starts):
        upper = d <= today if i == 0 else d < starts[i - 1]
        cells.append(F.sum(F.when((d >= start) & upper, 1)).alias(f"{prefix}{i + 1}"))
    return df.groupBy(*keys).agg(*cells)


def conditional_sums(
    df: DataFrame, value: Column, conditions: dict[str, Column], keys: list[str] | None = None
) -> DataFrame:
    """Several conditional sums side by side; NULL where nothing matched."""
    sums = [F.sum(F.when(cond, value)).alias(name) for name, cond in conditions.items()]
    return df.groupBy(*(keys or [])).agg(*sums)


def rollup_pivot(df: DataFrame, keep: list[str], cells: list[str]) -> DataFrame:
    """Pivot cells summed after grouping columns were left out."""
    return df.groupBy(*keep).agg(*[F.sum(c).alias(c) for c in cells])


def code_pivot(df: DataFrame, key: str, code: str, value: str, codes: dict, fill: int | None = 0) -> DataFrame:
    """Smallest value per key for each listed code, one column per code."""
    cells = []
    for c, name in codes.items():
        cell = F.min(F.when(F.col(code) == c, F.col(value)))
        cells.append((cell if fill is None else F.coalesce(cell, F.lit(fill))).alias(name))
    return df.groupBy(key).agg(*cells)
