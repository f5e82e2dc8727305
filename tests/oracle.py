"""Compares queries with their SQL, as the driver does: equal columns, types and rows in any order."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_cell(r[i]) for i in order) for r in data), key=repr)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What differs, or an empty string."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    kinds = dict(zip(names, (str(d[1]) for d in got.description)))
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} and {names}"
    same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    odd = {c: (k, kinds[c]) for c, k in df.dtypes if same.get(k) != kinds[c]}
    if odd:
        return f"types {odd}"
    ours, theirs = rows(df.columns, df.collect()), rows(names, got.fetchall())
    if ours != theirs:
        first = next(((a, b) for a, b in zip(ours, theirs) if a != b), None)
        return f"{len(ours)} and {len(theirs)} rows, first difference {first}"
    return ""
