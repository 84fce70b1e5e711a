"""Run a registered query and its SQL oracle on the same tables and compare all values."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value) if value % 1 else int(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda t: tuple((v is not None, str(type(v)) if isinstance(v, str) else "", v if v is not None else 0) for v in t))


def expected(con, sql):
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    return rows_of(columns, result.fetchall())


def actual(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def difference(con, df, sql) -> str | None:
    have, want = actual(df), expected(con, sql)
    if have[0] != want[0]:
        return f"columns {have[0]} != {want[0]}"
    if len(have[1]) != len(want[1]):
        return f"{len(have[1])} rows, expected {len(want[1])}"
    bad = [(a, b) for a, b in zip(have[1], want[1]) if a != b]
    if bad:
        return f"{len(bad)} of {len(want[1])} rows differ, first: {bad[0]}"
    return None
