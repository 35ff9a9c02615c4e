"""Projections (PRJ-1, PRJ-7 .. PRJ-9, PRJ-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.functions.nulls import nvl

# Suffixes of the four storage folders below a visit folder.
PATH_SUFFIXES = {"Final": "-Final", "EMail": "-EMail", "Original": "-Original", "Other": "-Others"}
BACKSLASH = "\\"


def select_light(df: DataFrame, drop: list[str]) -> DataFrame:
    """Projection without the heavy columns; the scan never reads them."""
    return df.drop(*drop)


def derive_paths(
    df: DataFrame,
    root: Column,
    folder: Column,
    last: Column,
    first: Column,
    number: Column,
    prefix: str = "Path",
    suffixes: dict[str, str] = PATH_SUFFIXES,
) -> DataFrame:
    """Visit folder below ``root`` and one sub-folder per suffix.

    Any missing part makes all paths NULL.
    """
    sep = F.lit(BACKSLASH)
    leaf = F.concat(last, F.lit(" "), first, F.lit(" "), number.cast("string"))
    base = F.concat(root, sep, folder, sep, leaf)
    paths = {prefix: base}
    for name, suffix in suffixes.items():
        paths[prefix + name] = F.concat(base, sep, leaf, F.lit(suffix))
    return df.withColumns(paths)


def render_message(lines: list[Column | tuple[Column, Column]], eol: str = "\r\n") -> Column:
    """Message text from lines, joined with ``eol``.

    A pair ``(condition, line)`` adds its line, with its line break, only where
    the condition holds.  A NULL line makes the whole message NULL.
    """
    text = None
    for i, line in enumerate(lines):
        tail = "" if i == len(lines) - 1 else eol
        if isinstance(line, tuple):
            cond, body = line
            part = F.when(cond, F.concat(body, F.lit(tail))).otherwise(F.lit(""))
        else:
            part = F.concat(line, F.lit(tail))
        text = part if text is None else F.concat(text, part)
    return text


def pad_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in order; those ``df`` lacks become NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


# The three kinds of tariff, in order of precedence.
TARIFF_KINDS = {"Constant": "C", "Percent": "P", "Limmit": "L"}
TARIFF_PHASES = {"Befor": ("TarrifBeforeType", "AmountBefore"), "After": ("TarrifAfterType", "AmountAfter")}


def resolve_tariff(location: Column, host: str = "H_", private: str = "D_") -> dict[str, Column]:
    """Columns of the tariff that applies at a location.

    Location 0 takes the amounts of the ``host`` columns, location 1 those of
    the ``private`` columns.  The type is the letter of the first amount that is
    present.
    """

    def at_location(column_of) -> Column:
        return F.when(location == 0, column_of(host)).when(location == 1, column_of(private))

    out = {"ForceAfter": at_location(lambda side: F.col(side + "ForceAfter"))}
    for phase, (type_col, amount_col) in TARIFF_PHASES.items():

        def letter(side: str, phase=phase) -> Column:
            return F.coalesce(
                *[
                    F.when(F.col(side + kind + phase).isNotNull(), code)
                    for kind, code in TARIFF_KINDS.items()
                ]
            )

        def amount(side: str, phase=phase) -> Column:
            return F.coalesce(*[F.col(side + kind + phase) for kind in TARIFF_KINDS])

        out[type_col], out[amount_col] = at_location(letter), at_location(amount)
    out["HasTarrif"] = F.when(
        nvl(out["TarrifBeforeType"], out["TarrifAfterType"]).isNotNull(), 1
    )
    return out
