"""op1 lays documents along the curve, in ranges of even bytes, and deals large groups of copies over several."""

import pyarrow as pa
from pyspark.sql import functions as F

from geoloom.llm import hilbert_pack, runtime


def test_sequences_follow_the_curve(spark):
    docs = runtime.table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    keys = dict(zip(texts, hilbert_pack.document_keys(pa.array(texts.values(), pa.string()), hilbert_pack._projection()).tolist(), strict=True))
    pieces = hilbert_pack.pack_documents(docs, with_ids=False, partition_bytes=200_000).orderBy("sequence_id", "offset").collect()
    places = [keys[r.doc_id] >> 30 - hilbert_pack.HISTOGRAM_BITS for r in pieces]
    assert places == sorted(places) and len({r.sequence_id >> 40 for r in pieces}) > 8
    by_range = {}
    for r in pieces:
        by_range.setdefault(r.sequence_id >> 40, []).append(keys[r.doc_id])
    assert all(x == sorted(x) for x in by_range.values())


def test_ranges():
    n, ranges = hilbert_pack.cut_curve({5: 100, 1: 50, 9: 1000, 12: 10}, 100)
    assert n == 12 and ranges[0] == (1, 0, 1) and ranges[1] == (5, 0, 2) and ranges[2][1:] == (1, 11) and all(a + b <= n for _, a, b in ranges)
    assert hilbert_pack.cut_curve({}, 100) == (1, []) and hilbert_pack.cut_curve({3: 7}, 100) == (1, [(3, 0, 1)])


def test_copies_are_dealt(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same words again and again " * 3).alias("text"))
    pieces = hilbert_pack.pack_documents(docs, with_ids=False, partition_bytes=30_000).groupBy(F.shiftright("sequence_id", 40).alias("r")).agg(F.count_distinct("doc_id").alias("n")).collect()
    assert len(pieces) > 8 and max(p.n for p in pieces) < 3 * 3000 / len(pieces)
