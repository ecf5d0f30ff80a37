"""Run registered queries in Spark and their SQL in DuckDB and hold the rows against each other, as the driver does."""

from __future__ import annotations

import math
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL" if v is None else "nan"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in data)


def differs(spark, con, sf_dir, query, sql) -> str:
    df = query(spark, sf_dir)
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    b = rows(rel.columns, rel.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if a[1] != b[1]:
        odd = [(x, y) for x, y in zip(a[1], b[1]) if x != y][:2]
        return f"{len(a[1])} rows in Spark, {len(b[1])} in SQL; {odd}"
    return "" if a[1] else "no rows"


def sf(size="sf0.001") -> str:
    return str(Path("/root/testdata") / size)
