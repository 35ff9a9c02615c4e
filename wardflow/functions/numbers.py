"""Integer arithmetic and casts (PRJ-10, MT-1, CV-1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardflow.functions.nulls import nvl


def int_div(a: Column, b) -> Column:
    """Integer division that truncates towards zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def age(birth_year: Column, refer_date: Column) -> Column:
    """Years between a birth year and the year of a date text."""
    return F.left(refer_date, F.lit(4)).try_cast("int") - birth_year.try_cast("int")


def line_fee(qty: Column, price: Column, default_qty: int = 0) -> Column:
    """Quantity times price; a missing quantity counts as ``default_qty``."""
    return nvl(qty, default_qty) * price


def reduced_price(price: Column, percent: Column) -> Column:
    """Price less a percentage whose amount is truncated to an integer."""
    return price - int_div(price * nvl(percent, 0), 100)


def cast_safe(c: Column, type_name: str) -> Column:
    """Cast that gives NULL for text that does not parse."""
    return c.try_cast(type_name)


def cut(c: Column, n: int) -> Column:
    """The first ``n`` characters of the value as text."""
    return F.left(c.cast("string"), F.lit(n))


def hex_to_number(c: Column) -> Column:
    """Number written in hexadecimal digits."""
    return F.conv(c, 16, 10).try_cast("bigint")
