"""op7 against the alignment of every document with every item, on the test tables and on edited copies."""

import re

import numpy as np

from geoloom.llm import decontamination as d
from geoloom.llm import runtime

SF = "/root/testdata/sf0.001"


def brute(texts, items, threshold=0.5, least=6):
    out = {}
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    for i, item in items.items():
        names = {w: k for k, w in enumerate(dict.fromkeys(words(item)))}
        code = np.array([names[w] for w in words(item)])
        if len(code) < 3:  # no seeds
            continue
        for doc, t in texts.items():
            window = np.array([names.get(w, -1) for w in words(t)])
            if len(window):
                score, a, b = d.align(code, window)
                if score >= max(threshold, min(len(code), least) / len(code)):
                    out[doc, i] = (round(score, 9), *[m.span()[k] for m, k in zip([list(re.finditer(r"\w+", t.lower()))[x] for x in (a, b - 1)], (0, 1))])
    return out


def found(docs, benchmark, **options):
    return {(r.doc_id, r.item_id): (round(r.score, 9), r.start, r.end) for r in d.find_leaks(docs, benchmark, **options).collect()}


def test_all_pairs(spark):
    docs, benchmark = runtime.table(spark, SF, "documents"), runtime.table(spark, SF, "benchmark")
    want = brute({r.doc_id: r.text or "" for r in docs.collect()}, {r.item_id: r.text for r in benchmark.collect()})
    assert want and found(docs, benchmark) == want


def test_edits(spark):
    rng = np.random.default_rng(11)
    common = [f"c{k}" for k in range(12)]
    make = lambda n: [common[rng.integers(12)] if rng.random() < 0.5 else f"r{rng.integers(10**6)}" for _ in range(n)]
    items = {i: make(int(n)) for i, n in enumerate([60, 40, 25, 15, 8, 5, 3, 2, 60])}
    texts, at = {}, 0
    for i, item in items.items():
        for step in (2, 3, 4, 5):
            for kind in ("replace", "drop", "insert", "both"):
                words = []
                for k, w in enumerate(item):
                    hit = k % step == step - 1
                    words += [w] if not hit else {"replace": ["x"], "drop": [], "insert": [w, "x"], "both": ["x"] if k % 2 else []}[kind]
                texts[at] = " ".join([*make(30), *words, *make(30)])
                at += 1
    for _ in range(60):
        texts[at] = " ".join(make(int(rng.integers(1, 200))))
        at += 1
    benchmark = {i: " ".join(x) for i, x in items.items()} | {90: None, 91: "", 92: "r"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = spark.createDataFrame(list(benchmark.items()), "item_id long, text string")
    want = brute(texts, benchmark)
    assert len(want) > 40 and found(docs, rows) == want and found(docs, rows, block_items=4) == want
    kept = {r.doc_id for r in d.drop_leaks(docs, rows).collect()}
    assert kept == set(texts) - {doc for doc, _ in want}


def test_rows_are_judged_by_their_own_text(spark):
    item = " ".join(f"word{k}" for k in range(30))
    docs = spark.createDataFrame([(1, item, 5), (1, "clean", 6), (None, item, 7), (None, "clean", 8)], "doc_id long, text string, item_id int")
    rows = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r.item_id for r in d.drop_leaks(docs, rows).collect()) == [6, 8]
    assert d.drop_leaks(docs, rows.where("false")).count() == 4 and d.drop_leaks(docs.where("false"), rows).count() == 0
