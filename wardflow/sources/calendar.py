"""Calendar dimension (DT-2, DT-3) generated by Spark."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.functions.dates import shamsi_number, to_shamsi, ymd

MAX_YEARS = 400


def build_calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row per day from ``first`` to ``last``.

    Weeks start on Saturday.  The span is limited to 400 years, so the result
    has at most about 146,000 rows.
    """
    start, end = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    if not start <= end or end.year - start.year > MAX_YEARS:
        raise ValueError(f"calendar span must be 0 to {MAX_YEARS} years")
    days = spark.range((end - start).days + 1).select(
        F.col("id").cast("int").alias("ID"),
        F.date_add(F.lit(first).cast("date"), F.col("id").cast("int")).alias("MiladiDate"),
    )
    return days.select(
        "ID",
        "MiladiDate",
        ymd(F.col("MiladiDate")).alias("Miladi"),
        to_shamsi(F.col("MiladiDate")).alias("Shamsi"),
        (shamsi_number(F.col("MiladiDate")) % 100).cast("int").alias("DayInMonth"),
        (F.dayofweek("MiladiDate") % 7 + 1).alias("DayInWeek"),
    )


def shamsi_of(df: DataFrame, calendar: DataFrame, date_col: str, out: str) -> DataFrame:
    """Gregorian to Solar Hijri through the calendar; NULL outside of it."""
    days = calendar.select(
        F.col("MiladiDate").alias("_day"), F.col("Shamsi").alias(out)
    )
    return df.join(days, F.col(date_col).cast("date") == F.col("_day"), "left").drop(
        "_day"
    )


def miladi_of(df: DataFrame, calendar: DataFrame, shamsi_col: str, out: str) -> DataFrame:
    """Solar Hijri to Gregorian text through the calendar; ``''`` outside of it."""
    days = calendar.select(F.col("Shamsi").alias("_day"), F.col("Miladi").alias("_miladi"))
    joined = df.join(days, F.col(shamsi_col) == F.col("_day"), "left")
    return joined.withColumn(out, F.coalesce("_miladi", F.lit(""))).drop("_day", "_miladi")


def today_shamsi(calendar: DataFrame, as_of: str) -> DataFrame:
    """The calendar row of the day ``as_of`` falls on."""
    return calendar.where(F.col("MiladiDate") == F.lit(as_of[:10]).cast("date")).select("Shamsi")
