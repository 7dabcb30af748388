"""Compare a query with its SQL on the test tables, as the driver does."""

from __future__ import annotations

import glob
import math
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    """DuckDB with every table as a view."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        src = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{src}')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v if isinstance(v, (int, str)) else str(v)


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    """Columns by name and the sorted rows."""
    cols = sorted(df.columns)
    rows = [tuple(_plain(x.asDict(True) if hasattr(x, "asDict") else x) for x in r) for r in df.select(cols).collect()]
    return cols, sorted(rows, key=repr)


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    """The same of a SQL query."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
