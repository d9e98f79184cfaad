"""op4 with repeated and null ids, by rows, against brute force; what drop_near_duplicates keeps."""

import numpy as np
from test_ops import brute_components

from geoloom.llm import parity_join


def brute_rows(rows, words, num, den):
    found = brute_components({k: t or "" for k, (_, t) in enumerate(rows)}, words, num, den)
    members = {}
    for k, (_, root) in found.items():
        members.setdefault(root, []).append(k)
    out, kept = [], []
    for root, group in members.items():
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        out += [(rows[k][0], found[k][0], min(ids) if ids else None) for k in group]
        kept.append(min(ids) if ids else None)
    return sorted(out, key=str), sorted(kept, key=str)


def test_rows(spark):
    text = " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"v{k}" for k in range(40))
    rows = [(3, text), (5, text), (5, other), (7, other + " more"), (4, text), (4, text), (None, text), (None, "alone in the world but null"), (None, None), (8, None), (8, ""), (9, " \t"), (9, "short"), (10, "short")]
    rng = np.random.default_rng(9)
    base = [f"b{k}" for k in range(80)]
    for _ in range(120):
        w = list(base)
        for at in rng.integers(0, 80, rng.integers(0, 4)):
            w[at] = f"x{rng.integers(0, 5)}"
        rows.append((int(rng.integers(20, 60)) if rng.random() < 0.8 else None, " ".join(w)))
    docs = spark.createDataFrame([(i, t, "c", k, k, "r", k, "rid") for k, (i, t) in enumerate(rows)], "doc_id long, text string, sketch string, n int, a int, row string, rep int, rid string")
    want, _ = brute_rows(rows, 4, 85, 100)
    assert sorted(map(tuple, parity_join.link_documents(docs, 4, 85, 100).collect()), key=str) == want
    _, kept = brute_rows(rows, 5, 4, 5)
    left = parity_join.drop_near_duplicates(docs, 5, 4, 5)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == kept
    assert {tuple(r) for r in left.collect()} <= {tuple(r) for r in docs.collect()}
    assert parity_join.drop_near_duplicates(docs.where("false")).count() == 0


def test_kept_rows_of_one_class(spark):
    docs = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert [r.doc_id for r in parity_join.drop_near_duplicates(docs).collect()] == [4]


def test_chunks_and_tiles_lose_nothing(spark):
    rng = np.random.default_rng(4)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 4)):
            w[at] = f"x{rng.integers(0, 5)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(dict(rows), 5, 4, 5)
    whole = parity_join.verified
    try:
        parity_join.verified = lambda *a: whole(*a, chunk=300, task=1000)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.link_documents(docs).collect()}
    finally:
        parity_join.verified = whole
    assert got == want
