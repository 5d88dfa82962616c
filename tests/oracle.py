"""Compares a query with its SQL on the test tables, as the driver does."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

SMALL = "/root/testdata/sf0.001"


def shown(value: object) -> str:
    if isinstance(value, float):
        return "nan" if value != value else repr(round(value, 9))
    return str(value)


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


def compare(spark, query: Callable, sql: str, folder: str = SMALL) -> None:
    import duckdb

    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    df = query(spark, folder)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, found.fetchall())
