"""op8 with components of any size, several lengths and clashing columns, against plain Python numbers."""

import math

import numpy as np
from pyspark.sql import functions as F

from geoloom.llm import topk


def brute(rows, is_query, k):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [int(x) * 1024 if abs(x) >= 2**52 else math.floor(x * 1024) for x in v]) for i, v in ok]
    out = []
    for q, v in whole:
        if is_query(q):
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s if -(1 << 63) <= -s < 1 << 63 else None) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_sizes_and_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(0, [200000.0]), (1, [150000.0]), (2, [-1e300]), (3, [1e300]), (4, [5e299]), (5, []), (100, []), (6, [float("nan")]), (7, None), (200, [None])]
    rows += [(n, [float(x) for x in rng.normal(size=6) * 10.0 ** rng.integers(-3, 9)]) for n in range(300, 420)]
    rows += [(n, [float(x) for x in rng.normal(size=12)]) for n in range(500, 700)]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")
    got = topk.top_k(frame, F.col("vec_id") % 100 == 0, 4, group_rows=16, query_block=2, dimension_block=3, together=2)
    assert sorted((tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()), key=lambda r: r[:2]) == brute(rows, lambda q: q % 100 == 0, 4)
    assert (0, 3, 1, 31457280000000000) in [tuple(r) for r in got.collect()]  # 200000 * 150000 * 1024**2, after the two huge ones
    assert topk.top_k(frame.where("false"), F.col("vec_id") % 100 == 0).count() == 0
