"""Text functions (ST-1 .. ST-7, FLT-10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardflow.functions.nulls import nvl

# The two letter pairs that differ between code pages.
PERSIAN_LETTERS = "کی"
ARABIC_LETTERS = "كي"


def _occurrences(s: Column, ch: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))


def count_char(s: Column, ch: str) -> Column:
    """How often ``ch`` occurs; trailing blanks do not count, NULL gives 0."""
    return nvl(_occurrences(F.rtrim(s), ch), 0)


def count_lines(s: Column) -> Column:
    """Line feeds in all but the last position; NULL gives 0."""
    body = F.rtrim(s)
    return nvl(_occurrences(F.substring(body, F.lit(1), F.length(body) - 1), "\n"), 0)


def to_arabic(s: Column, limit: int | None = None) -> Column:
    """Persian kaf and yeh to their Arabic forms; ``limit`` cuts the text at so many characters."""
    out = F.translate(s, PERSIAN_LETTERS, ARABIC_LETTERS)
    return out if limit is None else F.substring(out, 1, limit)


def to_persian(s: Column) -> Column:
    """Arabic kaf and yeh to their Persian forms."""
    return F.translate(s, ARABIC_LETTERS, PERSIAN_LETTERS)


def match_key(*parts: Column) -> Column:
    """Parts joined without blanks; NULL parts are skipped."""
    return F.replace(F.concat_ws("", *[p.cast("string") for p in parts]), F.lit(" "), F.lit(""))


def split_lines(s: Column, n: int = 4) -> list[Column]:
    """The first ``n`` lines, blanks trimmed, as ``n`` columns.

    Blank text gives NULLs, one line feed at the very end opens no new line,
    carriage returns stay.
    """
    body = F.regexp_replace(F.trim(s), "\\n\\z", "")
    lines = F.transform(F.split(body, "\n", -1), lambda line: F.trim(line))
    return [F.when(F.trim(s) != "", F.get(lines, F.lit(i))) for i in range(n)]


def classify_phone(c: Column) -> tuple[Column, Column]:
    """Route a number to (phone, mobile).

    One leading zero and the ``;`` separators are ignored; a number that then
    starts with 9 is a mobile.
    """
    is_mobile = F.left(F.regexp_replace(c, "(^|;)0|;", ""), F.lit(1)) == "9"
    return F.when(~is_mobile, c), F.when(is_mobile, c)


def mask_match(text: Column, mask: Column | str, mode: str = "and") -> Column:
    """1 where the text fits a positional mask, else 0.

    ``2`` in the mask is "any character".  In ``and`` mode all other positions
    must agree, in ``or`` mode one is enough.  NULL text never disagrees and
    never agrees; text that is too short disagrees.
    """
    if isinstance(mask, str):
        mask = F.lit(mask)
    width = F.length(F.rtrim(mask))
    # Positions of an empty or missing mask: none.
    places = F.when(width >= 1, F.sequence(F.lit(1), width)).otherwise(
        F.array().cast("array<int>")
    )

    def at(c: Column, i: Column) -> Column:
        return F.substring(c, i, F.lit(1))

    def fixed(i: Column) -> Column:
        return at(mask, i) != "2"

    if mode == "and":
        clash = F.exists(places, lambda i: fixed(i) & nvl(at(text, i) != at(mask, i), False))
        return F.when(clash, 0).otherwise(1)
    hit = F.exists(places, lambda i: fixed(i) & nvl(at(text, i) == at(mask, i), False))
    return F.when(hit, 1).otherwise(0)
