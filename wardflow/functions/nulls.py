"""Null handling, names, labels and flags (PRJ-2 .. PRJ-6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nvl(c: Column, default) -> Column:
    """``c``, or ``default`` where it is NULL."""
    return F.coalesce(c, default if isinstance(default, Column) else F.lit(default))


def null_if_blank(c: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def null_if_zero(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def same_or_default(c: Column, value, default=0) -> Column:
    """Equality on a flag whose NULL counts as ``default``."""
    return nvl(c, default) == nvl(F.lit(value), default)


def cat_strict(*parts: Column) -> Column:
    """Concatenation that is NULL as soon as one part is NULL."""
    return F.concat(*[p.cast("string") for p in parts])


def cat_loose(*parts: Column) -> Column:
    """Concatenation that treats NULL parts as empty text."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def percent_text(c: Column) -> Column:
    """Number as text, with a percent sign for 1..100 and none for amounts."""
    return F.when(c.between(1, 100), F.concat(c.cast("string"), F.lit("%"))).otherwise(
        c.cast("string")
    )


def full_name(first: Column, last: Column, order: str = "last_first", sep: str = " ") -> Column:
    """Trimmed person name; a missing part counts as empty text."""
    a, b = (last, first) if order == "last_first" else (first, last)
    return F.trim(F.concat(nvl(a, ""), F.lit(sep), nvl(b, "")))


def name_with_job(name: Column, job: Column, number: Column) -> Column:
    """``name (job)number``; NULL when job or number is NULL."""
    return F.concat(name, F.lit(" ("), job, F.lit(")"), number.cast("string"))


def name_dash_job(name: Column, job: Column, number: Column) -> Column:
    """``name  -  number  -  job``; NULL when job or number is NULL."""
    dash = F.lit("  -  ")
    return F.concat(name, dash, number.cast("string"), dash, job)


def decode(c: Column, labels: dict, default=None) -> Column:
    """Label of a code; unknown codes and NULL give ``default``."""
    out = None
    for code, label in labels.items():
        out = F.when(c == code, label) if out is None else out.when(c == code, label)
    return out.otherwise(F.lit(default))


def flag(cond: Column) -> Column:
    """1 where the condition holds, else 0 (also where it is NULL)."""
    return F.when(cond, 1).otherwise(0)


# Code tables of the clinic data model.
WAIT_STATUS = {
    1: "ثبت شد",
    2: "چک شد",
    4: "عکسبرداري شد",
    8: "خدمات تعيين شد",
    16: "تسويه حساب شد",
}
SEND_STATUS = {0: "اورژانس", 1: "عادي"}
SEX_TITLE = {0: "زن", 1: "مرد"}
DELIVERY_TITLE = {
    0: "",
    1: "صف ارسال",
    2: "ارسال موفق",
    3: "فايل يافت نشد",
    4: "",
    5: "خطا در ارسال",
}
SHORT_DELIVERY_TITLE = {0: "", 1: "صف", 2: "ارسال", 3: "فايل يافت نشد", 4: "", 5: "Failed"}
EMAIL_TITLE = {1: "صف", 2: "Failed", 3: "ارسال"}
BACK_COLOR = {0: "آبی", 1: "مشکی", 2: "سفید", 3: "سرمه ای"}
