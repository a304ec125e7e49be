"""Runs SQL in DuckDB over a folder of Parquet tables and compares rows."""

import glob
import os

import duckdb


def rows_of_sql(sql: str, folder: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = con.sql(sql)
    return got.columns, got.fetchall()


def _key(row):
    return tuple((x is None, str(x)) for x in row)


def assert_same(df, sql: str, folder: str) -> None:
    names, expected = rows_of_sql(sql, folder)
    assert sorted(df.columns) == sorted(names)
    got = [tuple(r[n] for n in names) for r in df.collect()]
    assert sorted(got, key=_key) == sorted(expected, key=_key)
