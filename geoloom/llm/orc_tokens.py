"""Token ids as ORC: integer run-length encoded lists, row indexes and a Bloom filter on doc_id.

Documents are range-partitioned and sorted by doc_id before they are encoded, so that the ORC files in the order
of their part numbers hold ascending doc_ids, stripes can be read in parallel and doc_id predicates skip stripes
by minimum, maximum and Bloom filter. Each row keeps its part number and its start within the part; a table of
one row for each part turns these into starts over all documents.

Cases: null and empty texts are the end id alone; very long texts are one list each; repeated doc_ids each keep a
row, in the order of a hash of the text (ties: as they come), which also splits one id's rows over parts; null doc_ids come first; an empty table gives an empty file set;
further columns of docs are not carried.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import new_path, table
from .tokens import encoder, text_slices

SCHEMA = "doc_id long, ids array<int>, n_tokens long, part int, part_start long"


def _encode(path):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            docs = batch.column(batch.schema.get_field_index("doc_id"))
            for first, last, texts in text_slices(batch):
                ids = encoder(path).encode(texts)
                sizes = np.array([len(x) for x in ids], np.int64)
                starts = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([docs.slice(first, last - first), lists, pa.array(sizes), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts)], ["doc_id", "ids", "n_tokens", "part", "part_start"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, stripe_bytes: int = 64 << 20) -> None:
    """Encode every whole text and write ORC files under path in ascending doc_id order."""
    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    (
        ordered.mapInArrow(_encode(tokenizer), SCHEMA).write
        .option("compression", "zstd").option("orc.stripe.size", str(stripe_bytes)).option("orc.create.index", "true").option("orc.row.index.stride", "1000")
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids; doc_ids are pushed to the ORC reader, which skips stripes by their metadata."""
    rows = spark.read.schema(SCHEMA).orc(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = parts.select("part", F.coalesce(before, F.lit(0)).alias("first"))
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    # One row for each output file: its size is that of the file list, which the driver holds in any case.
    return rows.join(F.broadcast(firsts), "part").select("doc_id", (F.col("first") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def _digest(batches):
    import pyarrow as pa

    for batch in batches:
        ids = batch.column(3)
        flat, ends = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.asarray(ids.offsets)
        ends = ends - ends[0]
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op2(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path).mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
