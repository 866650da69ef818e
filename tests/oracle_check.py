"""Side-by-side check of every registered query against its DuckDB oracle.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive multiset of values
(doubles rounded to 6 places, lists as tuples).
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _spark_kind(dt) -> str:
    from pyspark.sql import types as T
    if isinstance(dt, (T.LongType,)):
        return "BIGINT"
    if isinstance(dt, (T.IntegerType,)):
        return "INTEGER"
    if isinstance(dt, (T.ShortType, T.ByteType)):
        return "SMALLINT"
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return "DOUBLE" if isinstance(dt, T.DoubleType) else "FLOAT"
    if isinstance(dt, T.StringType):
        return "VARCHAR"
    if isinstance(dt, T.BooleanType):
        return "BOOLEAN"
    if isinstance(dt, T.ArrayType):
        return _spark_kind(dt.elementType) + "[]"
    if isinstance(dt, T.TimestampType):
        return "TIMESTAMP"
    return type(dt).__name__


def type_mismatches(sdf, cur) -> list:
    """Columns whose Spark and DuckDB types differ (by SQL type name)."""
    duck_types = {c[0]: str(c[1]) for c in cur.description}
    out = []
    for f in sdf.schema.fields:
        d = duck_types.get(f.name)
        if d is not None and _spark_kind(f.dataType) != d:
            out.append((f.name, _spark_kind(f.dataType), d))
    return out


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return dict(name=name, ok=None, rows=len(s_rows), spark_s=round(t1 - t0, 2))
    cur = con.execute(sql)
    types = type_mismatches(sdf, cur)
    d_cols = [c[0] for c in cur.description]
    d_rows = cur.fetchall()
    t2 = time.time()
    res = dict(name=name, rows=len(s_rows), oracle_rows=len(d_rows),
               spark_s=round(t1 - t0, 2), duck_s=round(t2 - t1, 2))
    if types:
        res["types"] = types
    if sorted(s_cols) != sorted(d_cols):
        res.update(ok=False, why=f"columns {sorted(s_cols)} vs {sorted(d_cols)}")
        return res
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    if len(a) != len(b):
        res.update(ok=False, why="row count")
        return res
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res.update(ok=False, why=f"values differ, e.g. {diff}")
        return res
    res.update(ok=True)
    return res


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    import __spark_entry__ as entry
    from tessera.session import build_session
    spark = build_session()
    con = duck(sf_dir)
    qs, orc = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, con, name, fn, orc.get(name), sf_dir)
        except Exception as e:  # report and go on
            r = dict(name=name, ok=False, why=f"{type(e).__name__}: {str(e)[:300]}")
        if r.get("ok") is False:
            bad += 1
        print(r, flush=True)
    print(f"failures: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
