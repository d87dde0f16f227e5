"""Rows of a query and of its SQL in DuckDB, in one order and with doubles rounded."""

import glob
import os

import duckdb


def normal(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(normal, v))
    if isinstance(v, dict):
        return tuple(map(normal, v.values()))
    return bytes(v) if isinstance(v, (bytes, bytearray)) else v


def connection(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(normal(v) for v in r) for r in df.select(*columns).collect()), key=repr)


def rows_of_sql(c, sql):
    relation = c.sql(sql)
    columns = sorted(relation.columns)
    names = ", ".join(f'"{x}"' for x in columns)
    return columns, sorted((tuple(normal(v) for v in r) for r in c.sql(f"SELECT {names} FROM ({sql})").fetchall()), key=repr)
