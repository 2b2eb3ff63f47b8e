"""Holds a query's rows against its SQL in DuckDB."""

from collections import Counter
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def same_rows(spark, name: str, query, sql: str, data: str) -> None:
    db = duckdb.connect()
    for file in Path(data).glob("*.parquet"):
        db.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    df = query(spark, data)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    out = db.execute(sql)
    names = [x[0] for x in out.description]
    assert sorted(names) == columns, (name, names)
    at = [names.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in out.fetchall())
    assert got == want, (name, list((got - want))[:3], list((want - got))[:3])
