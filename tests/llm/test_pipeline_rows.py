"""The pipeline's stages and run() against plain Python on the test tables, and on odd rows and empty tables."""

import re
import zlib

import numpy as np
import pytest
from test_ops import brute_components
from test_op7_all_pairs import brute as brute_leaks

import corpus_pipeline as c
from geoloom.llm import pii, runtime, tokens, toxicity

SF = "/root/testdata/sf0.001"


def test_run_equals_plain_python(spark):
    docs, labels = runtime.table(spark, SF, "documents"), runtime.table(spark, SF, "labels")
    texts = {r.doc_id: r.text for r in docs.collect()}
    scorer = toxicity.Scorer(*toxicity.fit(docs, labels))
    left = {i: t for i, t in texts.items() if scorer.score(t or "") < 0.5}
    left = {i: left[i] for i, (_, root) in brute_components({i: t or "" for i, t in left.items()}, 5, 4, 5).items() if root == i}
    items = {r.item_id: r.text for r in runtime.table(spark, SF, "benchmark").collect()}
    leaks = {i for i, _ in brute_leaks(left, items)}
    clean = {i: t for i, t in left.items() if i not in leaks}
    assert 0 < len(clean) < len(left) < len(texts)
    count = {}
    for t in clean.values():
        for *_, pattern in pii.candidates(t or ""):
            count[pattern] = count.get(pattern, 0) + 1
    accepted, ids = pii.train(count), {}
    for i, t in clean.items():
        base, extra = pii.all_spans(t or "", accepted)
        spans = sorted((a, b, k) for k, found in (base | extra).items() for a, b in found)
        out, last = "", 0
        for a, b, kind in spans:
            if b > last:
                out += t[last : max(a, last)] + (f"[{kind.upper()}]" if a >= last else "")
                last = b
        ids[i] = tokens.ChunkEncoder().encode([out + (t or "")[last:]])[0]
    got = {}
    for r in c.run(spark, SF).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        got.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert {i: [x for _, part in sorted(p) for x in part] for i, p in got.items()} == {i: x.tolist() for i, x in ids.items()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame([(1, " ".join(f"item{k}" for k in range(30)))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, 1), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_odd_rows(spark, folder):
    item = " ".join(f"item{k}" for k in range(30))
    rows = [(None, None), (None, ""), (1, " \t"), (2, "one two three four five six"), (2, "one two three four five six"), (None, "one two three four five six"), (2, f"before {item} after"), (2, "mail a@b.cc to me"), (3, "word " * 40000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 7, "n", "k", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, rid string, place string, n int")
    now = docs
    sizes = []
    for name, stage in c.STAGES[:-1]:
        now = runtime.materialise(stage(spark, now, folder), name)
        assert now.columns == docs.columns
        sizes.append(now.count())
    assert sizes == [9, 7, 6, 6]
    assert sorted((r.text or "" for r in now.collect())) == sorted(["", "", " \t", "one two three four five six", "mail [EMAIL] to me", "word " * 40000])
    packed = c.STAGES[-1][1](spark, now, folder)
    assert sum(r.length for r in packed.collect()) == sum(map(len, tokens.ChunkEncoder().encode([r.text or "" for r in now.collect()])))


def test_empty_tables(spark, folder):
    now = runtime.table(spark, SF, "documents").where("false")
    for name, stage in c.STAGES:
        now = runtime.materialise(stage(spark, now, folder), name)
        assert now.count() == 0
    assert re.search("ids", ",".join(now.columns))
