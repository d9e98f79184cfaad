"""op2's files: stripes, row indexes, Bloom filters and run-length encodings; what a filter on doc_id skips."""

from pyspark.sql import functions as F

from geoloom.llm import orc_tokens, runtime


def test_metadata_and_pruning(spark, tmp_path):
    docs = runtime.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    many = docs.select(F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"), "doc_id", F.substring("text", 1, 300).alias("text")).select((F.lit(10**12) + F.col("doc_id") * 12 + F.col("k")).alias("doc_id"), "text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else these few rows are one file
    try:
        orc_tokens.write_tokens(many.repartition(2), f"file://{tmp_path}/t", stripe_bytes=64 << 10)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    orc = jvm.org.apache.orc
    stripes, seen, files = 0, set(), sorted((tmp_path / "t").glob("*.orc"))
    last = -1
    for p in files:
        reader = orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"file://{p}"), orc.OrcFile.readerOptions(hadoop))
        assert reader.getRowIndexStride() == 1000
        names = list(reader.getSchema().getFieldNames())
        rows = reader.rows()
        for stripe in reader.getStripes():
            stripes += 1
            assert stripe.getIndexLength() > 0
            footer = rows.readStripeFooter(stripe)
            seen |= {(s.getColumn(), str(s.getKind())) for s in footer.getStreamsList()}
            kinds = [str(e.getKind()) for e in footer.getColumnsList()]
            assert kinds[1] == kinds[2] == kinds[3] == "DIRECT_V2"  # doc_id, lengths of the lists, ids
        rows.close()
        statistics = reader.getStatistics()[1 + names.index("doc_id")]
        assert statistics.getMinimum() > last  # files in the order of their names ascend
        last = statistics.getMaximum()
    assert stripes >= len(files) >= 2
    assert (1, "ROW_INDEX") in seen and any(c == 1 and k.startswith("BLOOM_FILTER") for c, k in seen) and not any(c > 1 and k.startswith("BLOOM_FILTER") for c, k in seen)

    wanted = [r.doc_id for r in many.where("doc_id % 5003 = 7").collect()]
    found = orc_tokens.read_tokens(spark, f"file://{tmp_path}/t", wanted)
    whole = {r.doc_id: (r.start, r.n_tokens, r.ids) for r in orc_tokens.read_tokens(spark, f"file://{tmp_path}/t").collect()}
    assert len(whole) == 12000 and wanted and {r.doc_id: (r.start, r.n_tokens, r.ids) for r in found.collect()} == {i: whole[i] for i in wanted}

    def scanned(ids):
        """Rows that the reader hands on for a filter on these ids, before the filter itself."""
        total = 0
        for p in files:
            reader = orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"file://{p}"), orc.OrcFile.readerOptions(hadoop))
            leaf = jvm.org.apache.hadoop.hive.ql.io.sarg.PredicateLeaf.Type.LONG
            box = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, len(ids))
            for k, i in enumerate(ids):
                box[k] = i  # beyond 32 bits, so a Long
            sarg = getattr(jvm.org.apache.hadoop.hive.ql.io.sarg.SearchArgumentFactory.newBuilder().startAnd(), "in")("doc_id", leaf, box).end().build()
            rows = reader.rows(reader.options().searchArgument(sarg, spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)))
            batch = reader.getSchema().createRowBatch()
            while rows.nextBatch(batch):
                total += batch.count()
            rows.close()
        return total

    assert scanned([wanted[0]]) <= 1000 and scanned([10**13]) == 0
    assert scanned([max(whole) + 1]) == 0
