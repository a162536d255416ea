"""Order-insensitive comparison of a Spark result with its DuckDB oracle:
row count, column names and a hash of the normalised values."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math

DRIVER_VIEWS = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v) -> str:
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "∅" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, decimal.Decimal)):
        return f"{float(v):.6f}"
    if isinstance(v, dt.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(v, dt.date):
        return v.strftime("%Y-%m-%d") + " 00:00:00.000000"
    return str(v)


def digest(cols, rows) -> tuple[str, list[str]]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in DRIVER_VIEWS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(df, con, sql) -> tuple[bool, str]:
    scols = df.columns
    srows = [tuple(r) for r in df.collect()]
    rel = con.execute(sql)
    ocols = [d[0] for d in rel.description]
    orows = rel.fetchall()
    if sorted(scols) != sorted(ocols):
        return False, f"columns {sorted(scols)} vs {sorted(ocols)}"
    h1, l1 = digest(scols, srows)
    h2, l2 = digest(ocols, orows)
    if len(srows) != len(orows) or h1 != h2:
        d1, d2 = sorted(set(l1) - set(l2))[:3], sorted(set(l2) - set(l1))[:3]
        return False, f"rows {len(srows)} vs {len(orows)}; spark-only {d1}; oracle-only {d2}"
    return True, f"{len(srows)} rows"
