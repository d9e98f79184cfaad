"""op5 writes its shards: folders, whole buckets in slot order, texts as they were; shuffled, and the same each time."""

import zlib

import pyarrow.parquet as pq

from geoloom.llm import runtime, sharding

SF = "/root/testdata/sf0.001"


def test_files(spark, tmp_path):
    docs = runtime.table(spark, SF, "documents")
    sharding.write_shards(docs, f"file://{tmp_path}/a", shards=3, bucket_bytes=20_000)
    sharding.write_shards(docs.repartition(5), f"file://{tmp_path}/b", shards=3, bucket_bytes=20_000)
    assert sorted(p.name for p in (tmp_path / "a").glob("shard=*")) == ["shard=0", "shard=1", "shard=2"]
    slots, order = {}, {}
    for p in (tmp_path / "a").glob("shard=*/*.parquet"):
        t = pq.read_table(p, partitioning=None).to_pylist()
        assert len({r["bucket"] for r in t}) == 1 and [r["slot"] for r in t] == list(range(t[0]["slot"], t[0]["slot"] + len(t)))
        assert sum(r["size"] for r in t) < 60_000 or len(t) < 4
        slots.setdefault(p.parent.name, []).extend(r["slot"] for r in t)
        order[p.parent.name, t[0]["bucket"]] = [r["doc_id"] for r in t]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(order) > 6
    assert any(ids != sorted(ids) for ids in order.values())
    a, b = (sharding.read_shards(spark, f"file://{tmp_path}/{x}", docs) for x in "ab")
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    for r in a.collect():
        assert (r.text, r.lang, r.source, r.n_chars) == (rows[r.doc_id].text, rows[r.doc_id].lang, rows[r.doc_id].source, rows[r.doc_id].n_chars)
        assert r.text_crc32 == zlib.crc32((r.text or "").encode())


def test_more_shards_take_into_themselves(spark):
    docs = runtime.table(spark, SF, "documents").select("doc_id", "text")
    few, many = ({r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard_documents(docs, n).collect()} for n in (4, 5))
    assert all(many[i][0] == few[i][1] and few[i][1] in (few[i][0], 4) for i in few)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", 7, 8, "x"), (1, "a", 7, 8, "x"), (None, None, 1, 2, "y")], "doc_id long, text string, shard int, cell int, law string")
    got = sharding.shard_documents(docs, 2)
    assert sorted(got.columns) == sorted(["doc_id", "text", "cell", *sharding.OUTPUT]) and sorted((r.cell, r.law) for r in got.collect()) == [(2, "key"), (8, "key"), (8, "key")]
