"""Row-set comparison between Spark results and the checking SQL."""

from __future__ import annotations

import datetime as dt
import decimal

import duckdb

from wardflow.bindings.star import BASE_TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _text(v) -> str:
    if v is None:
        return "\0"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, decimal.Decimal)):
        return str(int(v))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(" ")
    if isinstance(v, float):
        return repr(v)
    return str(v)


def canonical(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_text(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """``None`` when equal, else a short description of the difference."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want_rows = rel.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = canonical(df.columns, df.collect())
    want = canonical(names, want_rows)
    if len(got) != len(want):
        extra = sorted(set(got) - set(want))[:1], sorted(set(want) - set(got))[:1]
        return f"rows {len(got)} != {len(want)} {extra}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(bad)} rows differ, first {sorted(df.columns)} {bad[0]}"
    return None


def type_notes(df, con, sql: str) -> list[str]:
    """Columns whose integer width or kind differs between the two sides."""
    spark_kind = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    kinds = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [
        f"{c}: {t} / {kinds.get(c)}" for c, t in df.dtypes if spark_kind.get(t, t) != kinds.get(c)
    ]
