"""Run a query on Spark and its SQL on DuckDB over the same tables, and compare every row."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _norm(x)) for k, x in v.items())
    return v


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def spark_rows(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(v.asDict() if hasattr(v, "asDict") else v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    return cols, {c: t for c, t in df.dtypes}, sorted(rows, key=_key)


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in cur.fetchall()]
    return [names[i] for i in order], types, sorted(rows, key=_key)


SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


def differences(df, con, sql, limit=4) -> list[str]:
    sc, st, sr = spark_rows(df)
    dc, dt, dr = duck_rows(con, sql)
    out = []
    if sc != dc:
        return [f"columns {sc} vs {dc}"]
    for c in sc:
        if SAME.get(st[c], "").upper() != dt[c].upper() and not st[c].startswith(("array", "struct")):
            out.append(f"type of {c}: {st[c]} vs {dt[c]}")
    if len(sr) != len(dr):
        out.append(f"rows {len(sr)} vs {len(dr)}")
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        out.append(f"{len(bad)} of {len(sr)} rows differ")
        out += [f"  spark {a}\n  duck  {b}" for a, b in bad[:limit]]
    return out
