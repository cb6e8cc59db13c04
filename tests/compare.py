"""Spark results against DuckDB's over the same tables."""

from pathlib import Path

import duckdb


def tables(folder: str):
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return float(f"{value:.6g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def same(df, con, sql: str) -> None:
    own = rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.sql(sql)
    other = rows(result.columns, result.fetchall())
    assert sorted(df.columns) == sorted(result.columns)
    assert len(own) == len(other)
    assert own == other
