"""Registered queries against their SQL in DuckDB."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "as_integer_ratio"):
        return round(float(v), 6)
    return v


def same(df, con, sql: str) -> None:
    got = df.toPandas()
    rel = con.sql(sql)
    names = sorted(got.columns)
    assert names == sorted(rel.columns), (names, rel.columns)
    a = sorted((tuple(norm(v) for v in r) for r in got[names].itertuples(index=False, name=None)), key=repr)
    b = sorted((tuple(norm(v) for v in r) for r in rel.select(", ".join(f'"{n}"' for n in names)).fetchall()), key=repr)
    clean = lambda rows: [tuple(None if isinstance(v, float) and v != v or v == "nan" else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) if v is not None and not isinstance(v, bool) else v for v in r) for r in rows]
    a, b = sorted(clean(a), key=repr), sorted(clean(b), key=repr)
    assert len(a) == len(b), (len(a), len(b), a[:3], b[:3])
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, bad[:3]
