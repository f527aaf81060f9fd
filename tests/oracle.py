"""Compares a query with its DuckDB SQL, as bags of rows."""

import datetime
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str, sql: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*' if os.path.isdir(p) else ''}')")
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    return names, got.fetchall()


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    if isinstance(x, (list, tuple)):
        return tuple(norm(y) for y in x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    names, rows = duck(sf_dir, sql)
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    order = sorted(names)
    mine = sorted(tuple(norm(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(norm(r[names.index(c)]) for c in order) for r in rows)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    diff = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    assert not diff, diff[:3]
    return len(mine)
