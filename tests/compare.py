"""Run a query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from brindle.plans.tables import NAMES


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{sf_dir}/{n}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def same(df, con, text: str) -> str:
    """Empty if equal, else what differs."""
    cols = sorted(df.columns)
    result = con.execute(text)
    names = [d[0] for d in result.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    order = [names.index(c) for c in cols]
    # Rows are put in order by rounded values and compared by the values themselves.
    key = lambda r: tuple((v is None, str(round(v, 4) if isinstance(v, float) else v)) for v in r)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    b = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=key)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for x, y in zip(a, b):
        bad = [(c, p, q) for c, p, q in zip(cols, x, y) if p != q and not (isinstance(p, (int, float)) and isinstance(q, (int, float)) and math.isclose(p, q, rel_tol=1e-8, abs_tol=1e-9))]
        if bad:
            return f"{bad[:3]}"
    return ""
