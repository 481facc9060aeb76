"""A query's rows against those of its SQL on DuckDB, in any order."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(value) else round(float(value), 6) + 0.0
    if isinstance(value, datetime.datetime | datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def oracle(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def differences(df: DataFrame, sf_dir: str, sql: str) -> str:
    """What differs, or an empty string."""
    columns, wanted = oracle(sf_dir, sql)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    got, want = rows_of(df.columns, df.collect()), rows_of(columns, wanted)
    if got == want:
        return ""
    return f"{sum(got.values())} against {sum(want.values())} rows; only here {list((got - want).elements())[:3]}; only there {list((want - got).elements())[:3]}"
