"""Window operators (WN-1 .. WN-8).

Windows over a whole table would run in one task.  The total-order operators
here cut the rows into key ranges first, work inside each range and add what the
ranges before it contribute; that summary has one row per range.  Order columns
must end in a unique key, so that rows with equal leading values can still be
split over ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardflow.session import checkpointed

_BEFORE = (W.unboundedPreceding, -1)
_AFTER = (1, W.unboundedFollowing)


def as_column(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


RANGES_EACH, SAMPLED_EACH = 4, 50


def _key(cols: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)])


def in_ranges(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with the number of their key range in ``_range``, as a column computed from the key.

    The bounds are keys: those with the smallest hashes are a sample of bounded size, and
    every so many of them in order is a bound.  The same rows always give the same
    bounds, and a plan computes them once, so a task that is run again gives the same ranges.
    """
    ranges = RANGES_EACH * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = _key(cols)
    keys = df.select(key.alias("k"))
    sample = keys.orderBy(F.xxhash64("k"), "k").limit(ranges * SAMPLED_EACH)
    held = F.array_sort(F.collect_set("k"))
    every = F.transform(
        F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get(F.col("held"), F.floor(i * F.size("held") / ranges).cast("int"))
    )
    bounds = sample.agg(held.alias("held")).select(F.filter(every, lambda b: b.isNotNull()).alias("bounds")).scalar()
    # binary search: the number of bounds that are not above the key
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(ranges.bit_length()))])

    def further(low: Column, step: Column) -> Column:
        reached = (low + step <= F.size("_bounds")) & (F.get(F.col("_bounds"), low + step - 1) <= key)
        return F.when(reached, low + step).otherwise(low)

    bounded = df.withColumn("_bounds", bounds)
    return bounded.withColumn("_range", F.aggregate(halves, F.lit(0), further)).drop("_bounds")


def range_summary(ranged: DataFrame, cells: dict[str, Column]) -> DataFrame:
    """Aggregates per range: as many rows as there are ranges."""
    return ranged.groupBy("_range").agg(*[c.alias(n) for n, c in cells.items()])


_PLACE_BITS = 33


def placed_in_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in a total order with ``_range`` and the place in it, ``_place`` from 1.

    The ids that Spark gives to sorted ranges hold the range in the upper bits and
    the place in the lower 33, so one shuffle is enough; the checkpoint fixes them.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    fixed = checkpointed(ranged.withColumn("_at", F.monotonically_increasing_id()))
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + 1
    return fixed.withColumns({"_range": F.shiftright("_at", _PLACE_BITS), "_place": place}).drop("_at")


def numbered(df: DataFrame, order: list, name: str = "RW") -> DataFrame:
    """Row number over a total order (WN-1)."""
    placed = placed_in_order(df, [as_column(c) for c in order])
    counts = range_summary(placed, {"_rows": F.count(F.lit(1))})
    ahead = F.sum("_rows").over(W.orderBy("_range").rowsBetween(*_BEFORE))
    offsets = counts.select("_range", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    return (
        placed.join(F.broadcast(offsets), "_range")
        .withColumn(name, F.col("_place") + F.col("_ahead"))
        .drop("_range", "_place", "_ahead")
    )


def line_no(df: DataFrame, key: list, name: str = "RW") -> DataFrame:
    """Report line number; the table key makes it deterministic (WN-2)."""
    return numbered(df, key, name)


def renumber(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rewrite a number column as 1..n in the given order (WN-8)."""
    return numbered(df.drop(name), order, name)


def latest_and_rest(df: DataFrame, keys: list[str], ts: str, row_id: str) -> tuple[DataFrame, DataFrame]:
    """The newest row of each key, and all others (WN-3).

    ``row_id`` is unique; it breaks ties and separates the two outputs by an
    anti join on itself, so a key with very many rows is never one group.
    """
    newest = F.max(F.struct(ts, row_id)).alias("_top")
    ids = df.select(*keys, ts, row_id).groupBy(*keys).agg(newest).select(F.col("_top")[row_id].alias(row_id))
    return df.join(ids, row_id, "left_semi"), df.join(ids, row_id, "left_anti")


def period_starts(calendar: DataFrame, today: str, mode: str, n: int = 24) -> DataFrame:
    """The last ``n`` month (``M``) or week (``W``) starts up to a day (WN-4)."""
    start = F.col("DayInMonth") == 1 if mode == "M" else F.col("DayInWeek") == 1
    last = (
        calendar.where((F.col("Shamsi") <= today) & start)
        .select("ID", "Shamsi")
        .orderBy(F.desc("ID"))
        .limit(n)
    )
    # At most n rows are left, so one task numbers them.
    return last.select(
        "Shamsi", F.row_number().over(W.orderBy(F.desc("ID"))).alias("RowNO")
    )


def first_last(df: DataFrame, order: list[str], col: str, names=("FirstValue", "LastValue")) -> DataFrame:
    """First and last value over the whole order, on every row (WN-5)."""
    key = F.struct(*order)
    first = df.agg(F.min_by(col, key).alias("v")).scalar()
    last = df.agg(F.max_by(col, key).alias("v")).scalar()
    return df.select("*", first.alias(names[0]), last.alias(names[1]))


def navigate(df: DataFrame, key: str, moves: DataFrame, current: str = "current", direction: str = "direction") -> DataFrame:
    """Neighbour of each current key (WN-6).

    Directions are F(irst), P(revious), C(urrent), N(ext) and L(ast).  Moves past
    an end stay there.  A current key that is not in ``df`` counts as lying
    between its neighbours.  Adds ``target``, ``RowNO`` and ``RowStatus`` (F, L
    or FL at the ends).
    """
    real = df.select(F.col(key).alias("_k"), F.lit(True).alias("_real"))
    asked = moves.select(F.col(current).alias("_k"), F.lit(False).alias("_real"))
    points = real.unionByName(asked).groupBy("_k").agg(
        F.max("_real").alias("_real"), F.max(~F.col("_real")).alias("_asked")
    )
    ranged = in_ranges(points, ["_k"])
    hit = F.when(F.col("_real"), F.col("_k"))
    summary = range_summary(
        ranged, {"_lo": F.min(hit), "_hi": F.max(hit), "_rows": F.count(hit)}
    )
    ahead, behind = (W.orderBy("_range").rowsBetween(*f) for f in (_BEFORE, _AFTER))
    carried = summary.select(
        "_range",
        F.max("_hi").over(ahead).alias("_prev_range"),
        F.min("_lo").over(behind).alias("_next_range"),
        F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_ahead"),
    )
    # one order for all three looks: back, ahead and the count so far
    up = W.partitionBy("_range").orderBy("_k")
    placed = (
        ranged.withColumn("_hit", hit)
        .select(
            "*",
            F.max("_hit").over(up.rowsBetween(*_BEFORE)).alias("_prev"),
            F.expr("lead(_hit) IGNORE NULLS OVER (PARTITION BY _range ORDER BY _k)").alias("_next"),
            F.count("_hit").over(up.rowsBetween(W.unboundedPreceding, 0)).alias("_pos"),
        )
        .where(F.col("_asked"))
        .join(F.broadcast(carried), "_range")
        .select(
            "_k",
            "_real",
            F.coalesce("_prev", "_prev_range").alias("_prev"),
            F.coalesce("_next", "_next_range").alias("_next"),
            (F.col("_pos") + F.col("_ahead")).alias("_pos"),
        )
    )
    first = df.agg(F.min(key).alias("v")).scalar()
    last = df.agg(F.max(key).alias("v")).scalar()
    total = df.agg(F.count(key).alias("v")).scalar()
    way, pos, is_real = F.col(direction), F.col("_pos"), F.col("_real")
    one = F.lit(1).cast("bigint")
    target = (
        F.when(way == "F", first)
        .when(way == "L", last)
        .when(way == "P", F.coalesce("_prev", first))
        .when(way == "N", F.coalesce("_next", last))
        .when((way == "C") & is_real, F.col("_k"))
        .when(way == "C", F.coalesce("_prev", last))
    )
    row_no = (
        F.when(way == "F", one)
        .when(way == "L", total)
        .when(way == "P", F.greatest(one, F.when(is_real, pos - 1).otherwise(pos)))
        .when(way == "N", F.least(total, pos + 1))
        .when((way == "C") & (pos > 0), pos)
        .when(way == "C", total)
    )
    placed_moves = moves.join(placed, F.col(current) == F.col("_k"), "inner")
    status = F.concat(
        F.when(F.col("RowNO") == 1, "F").otherwise(""),
        F.when(F.col("RowNO") == total, "L").otherwise(""),
    )
    return placed_moves.select(
        *moves.columns, target.alias("target"), row_no.alias("RowNO")
    ).select("*", status.alias("RowStatus"))


def lead_in(df: DataFrame, part: list[str], order: list[str], col: str, name: str = "Edge") -> DataFrame:
    """Next value of ``col`` inside its partition, NULL on the last row (WN-7).

    Ranges cover partition and order columns together, so a partition with very
    many rows is spread over several ranges.
    """
    ranged = in_ranges(df, [*part, *order])
    row = F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate([*part, *order])], F.col(col).alias("v"))
    heads = range_summary(ranged, {"_head": F.min(row)})
    # Every range has rows, so the next range always holds the next row.
    after = heads.select("_range", F.lead("_head").over(W.orderBy("_range")).alias("_after"))
    inside = W.partitionBy("_range").orderBy(*part, *order)
    following = F.coalesce(F.lead(row).over(inside), F.col("_after"))
    same = [F.col("_following")[f"p{i}"].eqNullSafe(F.col(c)) for i, c in enumerate(part)]
    matched = same[0]
    for cond in same[1:]:
        matched = matched & cond
    return (
        ranged.join(F.broadcast(after), "_range")
        .withColumn("_following", following)
        .withColumn(name, F.when(matched, F.col("_following")["v"]))
        .drop("_range", "_after", "_following")
    )


def group_no(df: DataFrame, order: list[str], name: str = "GrpNo") -> DataFrame:
    """Dense rank over all rows, counted from 0 (WN-7)."""
    values = numbered(df.select(*order).distinct(), order, name)
    values = values.select(*[F.col(c).alias(f"_{c}") for c in order], (F.col(name) - 1).alias(name))
    cond = None
    for c in order:
        same = F.col(c).eqNullSafe(F.col(f"_{c}"))
        cond = same if cond is None else cond & same
    return df.join(values, cond, "inner").drop(*[f"_{c}" for c in order])
