"""Run a query and its DuckDB SQL over the same tables and compare the rows, whatever their order."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v) -> str:
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "~" if v != v else str(int(v)) if v == int(v) and abs(v) < 1e15 else f"{v:.9g}"
    return str(v)


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted("|".join(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> None:
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, want.fetchall())
    assert len(a) == len(b)
    assert [x for x in zip(a, b, strict=True) if x[0] != x[1]][:3] == []
