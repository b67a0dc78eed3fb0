"""Order-insensitive comparison of a query's rows with DuckDB's."""

from __future__ import annotations

import os

import duckdb


def connect(data: str):
    con = duckdb.connect()
    for name in os.listdir(data):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{data}/{name}'")
    return con


def same_rows(con, df, sql: str) -> None:
    columns = sorted(df.columns)
    mine = [tuple(r) for r in df.select(*columns).collect()]
    theirs = con.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({sql})").fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    plain = lambda r: tuple(float(x) if hasattr(x, "as_tuple") else x for x in r)
    assert sorted(map(plain, mine), key=key) == sorted(map(plain, theirs), key=key)
