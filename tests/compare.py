"""Runs a query and its SQL side by side, as the driver does."""

from __future__ import annotations

import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return int(x) if isinstance(x, bool) else float(x) if type(x).__name__ == "Decimal" else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def difference(spark, con, query, sql, sf_dir: str = SF) -> str:
    """Empty if the results agree, else what differs."""
    df = query(spark, sf_dir)
    res = con.sql(sql)
    if sorted(df.columns) != sorted(res.columns):
        return f"columns {sorted(df.columns)} against {sorted(res.columns)}"
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(res.columns, res.fetchall())
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}; first {[r for r in a if r not in b][:2]} against {[r for r in b if r not in a][:2]}"

    def same(x, y):
        if isinstance(x, float) and isinstance(y, (int, float)) or isinstance(y, float) and isinstance(x, (int, float)):
            return math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-5)
        return x == y

    bad = [(x, y) for x, y in zip(a, b, strict=True) if not all(map(same, x, y))]
    return f"{len(bad)} of {len(a)} rows differ: {bad[:2]}" if bad else ("" if a else "no rows")
