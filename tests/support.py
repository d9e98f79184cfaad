"""Spark rows against DuckDB rows."""

import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def near(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-7, abs_tol=2e-6)
    return a == b


def check(spark, query, sql, folder=DATA):
    db = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        db.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    df = query(spark, folder)
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    key = lambda r: [(v is None, str(v)) if not isinstance(v, float) else (False, f"{v:.3f}") for v in r]
    want = sorted(found.fetchall(), key=key)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=key)
    assert len(got) == len(want), (len(got), len(want))
    bad = [(a, b) for a, b in zip(got, want) if not all(map(near, a, b))]
    assert not bad, (len(bad), bad[:3])
    return len(got)
