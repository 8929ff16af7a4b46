"""Spark result vs DuckDB oracle, the way the correctness gate compares:
columns sorted by name, row count, then an order-insensitive multiset of
rendered rows (doubles rounded to 6 places)."""

from __future__ import annotations

import datetime as _dt
import decimal
import math

from vetrina.sources.tables import TABLES


def duckdb_conn(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return str(v.normalize()) if v == v else None
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name: str, sf_dir: str, queries, oracles):
    sdf = queries[name](spark, sf_dir)
    s_cols, s_rows = rows_of(sdf.columns, [tuple(r) for r in sdf.collect()])
    res = {"name": name, "spark_rows": len(s_rows)}
    if name not in oracles:
        res["status"] = "rows-only"
        return res
    rel = con.sql(oracles[name])
    o_cols, o_rows = rows_of(rel.columns, rel.fetchall())
    res["oracle_rows"] = len(o_rows)
    res["schema_ok"] = s_cols == o_cols
    res["values_ok"] = s_rows == o_rows
    res["status"] = "match" if (res["schema_ok"] and res["values_ok"]) else "MISMATCH"
    if res["status"] != "match":
        res["spark_cols"], res["oracle_cols"] = s_cols, o_cols
        sset, oset = set(s_rows), set(o_rows)
        res["only_spark"] = [r for r in s_rows if r not in oset][:3]
        res["only_oracle"] = [r for r in o_rows if r not in sset][:3]
    return res
