"""Calendar and clock functions (DT-1 .. DT-9, FLT-3, FLT-11)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardflow.functions.nulls import nvl

# The 33-year cycle of the Solar Hijri calendar.
EPOCH = "1900-01-01"
EPOCH_DAY = 466701
CYCLE_DAYS = 12053
CYCLE_YEARS = 33
# The first six months have 31 days, the others 30 (the last 29 or 30).
LONG_MONTHS_DAYS = 186
MISSING_AGE = 999
DEFAULT_EPOCH = "2000-01-01"


def _div(a: Column, b: int) -> Column:
    # Integral division keeps the arithmetic exact and inside generated code.
    return F.call_function("div", a, F.lit(b))


def shamsi_number(d: Column) -> Column:
    """Date as the number ``yyyymmdd`` of the Solar Hijri calendar.

    A cycle of 33 years has 12,053 days, so the year follows from the day number
    by one division, and the first day of a year by another.  Months are
    numbered by what they add to ``day of year``: 69 beyond a 31-day month, 70
    beyond a 30-day month.  Few repeated terms keep the expression small when
    many date columns are converted in one projection.
    """
    days = F.datediff(d.cast("date"), F.lit(EPOCH).cast("date")) + EPOCH_DAY
    years = _div(days * CYCLE_YEARS + 3, CYCLE_DAYS)
    day_of_year = days - _div(years * CYCLE_DAYS + 29, CYCLE_YEARS)
    long_months = _div(F.least(day_of_year, F.lit(LONG_MONTHS_DAYS)), 31)
    short_months = _div(F.greatest(day_of_year - LONG_MONTHS_DAYS, F.lit(0)), 30)
    return (years + 1) * 10000 + day_of_year + long_months * 69 + short_months * 70 + 101


def to_shamsi(d: Column) -> Column:
    """Date as ``yyyy/mm/dd`` text of the Solar Hijri calendar."""
    digits = F.lpad(shamsi_number(d).cast("string"), 8, "0")
    slash = F.lit("/")
    return F.overlay(F.overlay(digits, slash, 7, 0), slash, 5, 0)


def from_shamsi(s: Column) -> Column:
    """Date of a ``yyyy/mm/dd`` text of the Solar Hijri calendar; NULL where there is no such day.

    Over a literal it is computed once, while the query is planned, so a range of
    days can be compared with a date column itself and reaches the scan.
    """
    part = F.split(s, "/", -1)
    year, month, day = (F.get(part, F.lit(i)).try_cast("int") for i in range(3))
    before = _div((year - 1) * CYCLE_DAYS + 29, CYCLE_YEARS)
    months = F.when(month <= 6, (month - 1) * 31).otherwise((month - 7) * 30 + LONG_MONTHS_DAYS)
    days = (before + months + day - 1 - EPOCH_DAY).cast("int")
    found = F.date_add(F.lit(EPOCH).cast("date"), days)
    return F.when(to_shamsi(found) == s, found)


def on_days(ts: Column, first: Column, last: Column) -> Column:
    """The moment lies on one of the days from ``first`` to ``last``; compares the column itself."""
    return (ts >= first.cast("timestamp_ntz")) & (ts < F.date_add(last, 1).cast("timestamp_ntz"))


def timestamp_lit(as_of: str | dt.datetime) -> Column:
    """A wall-clock moment as a literal without time zone."""
    return F.lit(str(as_of)).cast("timestamp_ntz")


def add_time(c: Column, n, unit: str = "day") -> Column:
    """Moment plus ``n`` days, hours or minutes."""
    step = {"day": "days", "hour": "hours", "minute": "mins"}[unit]
    n = n if isinstance(n, Column) else F.lit(n)
    return c + F.make_dt_interval(**{step: n.cast("int")})


def datediff_boundary(unit: str, a: Column, b: Column) -> Column:
    """How many ``unit`` boundaries lie between ``a`` and ``b``."""
    if unit == "year":
        return F.year(b) - F.year(a)
    if unit == "month":
        return (F.year(b) * 12 + F.month(b)) - (F.year(a) * 12 + F.month(a))
    days = F.datediff(b, a)
    if unit == "day":
        return days
    if unit == "hour":
        return days * 24 + F.hour(b) - F.hour(a)
    if unit == "minute":
        return days * 1440 + (F.hour(b) * 60 + F.minute(b)) - (F.hour(a) * 60 + F.minute(a))
    raise ValueError(f"unknown unit {unit!r}")


def age_at_least(c: Column, as_of: Column, n, unit: str = "minute") -> Column:
    """At least ``n`` units passed since ``c``; a missing time counts as 999."""
    return nvl(datediff_boundary(unit, c, as_of), MISSING_AGE) >= n


def age_at_most(c: Column, as_of: Column, n, unit: str = "day") -> Column:
    """At most ``n`` units passed since ``c``; a missing time does not match."""
    return datediff_boundary(unit, c, as_of) <= n


def before_days(c: Column, as_of: Column, days: int) -> Column:
    """Earlier than ``days`` days before ``as_of``."""
    return c < add_time(as_of, -days)


def hhmm(c: Column) -> Column:
    """Clock part as ``HH:mm``."""
    return F.concat(
        F.lpad(F.hour(c).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad(F.minute(c).cast("string"), 2, "0"),
    )


def ymd(c: Column) -> Column:
    """Day part as ``yyyy/MM/dd`` in the Gregorian calendar."""
    return F.replace(c.cast("date").cast("string"), F.lit("-"), F.lit("/"))


def is_automatic(auto_ts: Column, manual_ts: Column) -> Column:
    """True where the automatic time is not older than the manual one."""
    epoch = F.lit(DEFAULT_EPOCH).cast("timestamp_ntz")
    return nvl(auto_ts, epoch) >= nvl(manual_ts, epoch)


def pick_latest(auto_ts: Column, manual_ts: Column, auto_value: Column, manual_value: Column) -> Column:
    """Value that belongs to the later of the two times, automatic on ties."""
    return F.when(is_automatic(auto_ts, manual_ts), auto_value).otherwise(manual_value)


def clock_minutes(a: Column, b: Column) -> Column:
    """Minutes from ``HH:mm`` text ``a`` to ``HH:mm`` text ``b`` on one day."""

    def minutes(c: Column) -> Column:
        return F.substring(c, 1, 2).try_cast("int") * 60 + F.substring(c, 4, 2).try_cast("int")

    return minutes(b) - minutes(a)


def repair_date(s: Column) -> Column:
    """Short date text to ``yyyy/mm/dd``.

    Only text of 1 to 9 characters with three parts changes: a two-digit year
    gets ``13`` in front, a three-digit year ``1``; month and day are padded.
    """
    parts = F.split(s, "/", -1)
    year, month, day = (F.get(parts, F.lit(i)) for i in range(3))
    year = (
        F.when(F.length(year) == 2, F.concat(F.lit("13"), year))
        .when(F.length(year) == 3, F.concat(F.lit("1"), year))
        .otherwise(year)
    )
    fixed = F.concat_ws("/", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    broken = F.length(F.rtrim(s)).between(1, 9) & (F.size(parts) == 3)
    return F.when(broken, fixed).otherwise(s)


def date_text_between(c: Column, lo: str | None, hi: str | None) -> Column:
    """Inclusive range on zero-padded date text; a missing bound is open."""
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (c >= lo)
    if hi is not None:
        cond = cond & (c <= hi)
    return cond
