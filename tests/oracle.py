"""Comparison of a query with its SQL, as sets of rows."""

from __future__ import annotations

import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

FOLDER = Path("/root/testdata/sf0.001")


def plain(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def database(folder: Path = FOLDER):
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def rows(names: list[str], data) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def differences(df, con, sql: str) -> tuple[Counter, Counter]:
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    a, b = rows(df.columns, map(tuple, df.collect())), rows(names, got.fetchall())
    return a - b, b - a
