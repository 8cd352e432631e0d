"""Comparison of a query with its DuckDB SQL: columns by name, rows as a bag, floats to nine places."""

from __future__ import annotations

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v: object) -> str:
    if isinstance(v, float):
        return repr(round(v, 9))
    return "[" + ",".join(map(text, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


def bag(rows: list, columns: list[str]) -> tuple:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(text(r[k]) for k in order) for r in rows)


def duck(sf_dir: str, sql: str) -> tuple:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = con.sql(sql)
    return bag(found.fetchall(), found.columns)


def both(spark, sf_dir: str, query, sql: str) -> tuple[tuple, tuple]:
    df = query(spark, sf_dir)
    return bag([tuple(r) for r in df.collect()], df.columns), duck(sf_dir, sql)
