"""Side-by-side check of a Spark query against DuckDB SQL on the same parquet
tables: column names, row count and order-insensitive values (doubles rounded
to 6 places), the way the driver compares them."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb
import numpy as np

from linklens.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, (float, np.floating)):
        f = float(v)
        if math.isnan(f):
            return None
        r = round(f, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, decimal.Decimal):
        return _norm(float(v))
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return float(int(v))
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    return str(v)


def rows_of(records: list[dict]) -> tuple[list[str], list[tuple]]:
    if not records:
        return [], []
    cols = sorted(records[0].keys())
    rows = [tuple(_norm(r[c]) for c in cols) for r in records]
    return cols, sorted(rows, key=repr)


def spark_rows(df):
    cols = sorted(df.columns)
    recs = [r.asDict(recursive=True) for r in df.collect()]
    return cols, rows_of(recs)[1] if recs else []


def duck_rows(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    recs = [dict(zip(names, r)) for r in rel.fetchall()]
    return sorted(names), (rows_of(recs)[1] if recs else [])


def compare(df, con, sql) -> dict:
    sc, sr = spark_rows(df)
    dc, dr = duck_rows(con, sql)
    out = {"spark_cols": sc, "duck_cols": dc, "spark_rows": len(sr), "duck_rows": len(dr),
           "cols_match": sc == dc, "rows_match": len(sr) == len(dr), "values_match": sr == dr}
    if not out["values_match"]:
        diff_s = [r for r in sr if r not in set(dr)][:3]
        diff_d = [r for r in dr if r not in set(sr)][:3]
        out["spark_only"], out["duck_only"] = diff_s, diff_d
    return out
