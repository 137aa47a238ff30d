"""Compare a registered Spark query with its DuckDB oracle (same as the driver's gate:
row count, column names, order-insensitive value hash)."""

from __future__ import annotations

import hashlib
import math

import duckdb

from cohortlens.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        v = round(v, 6)
        if v == 0:
            v = 0.0
        return repr(v)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return repr(float(v)) if False else str(v)
    return str(v)


def digest(columns: list[str], rows: list[tuple]) -> tuple[list[str], str, int]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return [columns[i] for i in order], h, len(rows), lines


def compare(spark, con, name, fn, sql, sf_dir):
    sdf = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    s_cols = sdf.columns
    d = con.execute(sql)
    d_cols = [x[0] for x in d.description]
    d_rows = d.fetchall()
    sc, sh, sn, sl = digest(s_cols, s_rows)
    dc, dh, dn, dl = digest(d_cols, d_rows)
    problems = []
    if sc != dc:
        problems.append(f"columns spark={sc} duck={dc}")
    if sn != dn:
        problems.append(f"rows spark={sn} duck={dn}")
    if sh != dh and not problems:
        diff_s = sorted(set(sl) - set(dl))[:3]
        diff_d = sorted(set(dl) - set(sl))[:3]
        problems.append(f"values differ: spark-only {diff_s} duck-only {diff_d}")
    return problems
