"""Rows of a Spark frame against those of DuckDB, whatever their order."""

import datetime
import math


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "asDict"):
        v = tuple(v.asDict().values())
    if isinstance(v, dict):
        v = tuple(v.values())
    return tuple(map(norm, v)) if isinstance(v, list | tuple) else v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    cols = sorted(names)
    rows = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in rows), key=repr)
