"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters records uniformly by seeded hashes into buckets that fit in memory, one for each partition; pass two
permutes each bucket (Spark's `shuffle` is a Fisher-Yates shuffle), numbers its records and writes them: one folder
for each shard, whose files hold whole buckets in slot order. A record's shard is the one of 0..n-1 with the largest
seeded hash of (doc_id, shard) (rendezvous hashing), so doc_id and the shard count alone decide, and one more shard
takes records only into itself: law `key`. Within a shard a second hash, of doc_id and text, deals records over
buckets.

Cases: null texts have no bytes (size 1, crc32 of nothing); null doc_ids are hashed like any value, spread over
buckets by their texts; a text longer than bucket_bytes makes its bucket that much larger; rows equal in doc_id and
text lie in one bucket, each with a slot, their order among themselves being without effect; equal hashes go to the
larger shard number; an empty table gives an empty result; further columns are carried unless their names are those
of the result, which win.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import new_path, table, text_or_empty

OUTPUT = ("size", "text_crc32", "law", "bucket", "slot", "grown_shard", "shard")
#: Buckets at most: beyond, they grow. Their counts, a row each, are sent to all tasks.
MOST_BUCKETS = 1_000_000


def rendezvous(column: str, shards: int, seed: int):
    """The shard with the largest hash of (seed, key, shard); ties go to the larger shard number."""
    ranked = [F.struct(F.xxhash64(F.lit(seed), F.col(column), F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return (F.greatest(*ranked) if shards > 1 else ranked[0])["s"]


def write_shards(docs: DataFrame, path: str, shards: int = 8, bucket_bytes: int = 16 << 20, seed: int = 42) -> None:
    """Write docs with OUTPUT as Parquet, a folder shard=N for each shard; slots are gapless from 0 within a shard.

    bucket_bytes bounds a bucket's text; the bucket count follows from one aggregate over the table.
    """
    docs = docs.drop(*[c for c in docs.columns if c in OUTPUT])
    size = F.octet_length(text_or_empty()).cast("long") + 1
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    parts = min(max(1, -(-total // (shards * bucket_bytes))), max(1, MOST_BUCKETS // shards))
    cell = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("text")), F.lit(parts)).cast("int")
    record = F.struct(*[F.col(c) for c in docs.columns], size.alias("size"), F.crc32(F.encode(text_or_empty(), "UTF-8")).alias("text_crc32"))
    placed = docs.select((rendezvous("doc_id", shards, seed) * parts + cell).cast("int").alias("cell"), record.alias("r"))

    counts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    of_shard = F.floor(F.col("cell") / parts).cast("int")
    before = F.sum("n").over(Window.partitionBy(of_shard).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    firsts = F.broadcast(counts.select("cell", F.coalesce(before, F.lit(0)).alias("first")))  # MOST_BUCKETS rows at most

    numbered = F.struct(F.col("r.doc_id"), F.xxhash64("r.text_crc32", "r.text").alias("tie"), F.col("r"))
    buckets = placed.repartitionById(shards * parts, "cell").groupBy("cell").agg(F.collect_list(numbered).alias("rows"))
    # shuffle() adds its partition's number to the seed: each bucket has a permutation of its own.
    mixed = buckets.select("cell", F.shuffle(F.array_sort("rows", _by_key), seed).alias("rows"))
    slots = mixed.join(firsts, "cell").select("cell", "first", F.posexplode("rows").alias("at", "x")).select(
        *[F.col(f"x.r.{c}").alias(c) for c in docs.columns], F.col("x.r.size").alias("size"), F.col("x.r.text_crc32").alias("text_crc32"),
        F.lit("key").alias("law"), F.pmod("cell", F.lit(parts)).alias("bucket"), (F.col("first") + F.col("at")).cast("long").alias("slot"), of_shard.alias("shard"),
    )
    out = slots.withColumn("grown_shard", rendezvous("doc_id", shards + 1, seed)).select(*docs.columns, *OUTPUT)
    out.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The rows of write_shards; like: the frame that was written."""
    held = [f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema if f.name not in OUTPUT]
    added = ["size long", "text_crc32 long", "law string", "bucket int", "slot long", "grown_shard int", "shard int"]
    return spark.read.schema(", ".join([*held, *added])).parquet(path)


def shard_documents(docs: DataFrame, shards: int = 8, bucket_bytes: int = 16 << 20, seed: int = 42) -> DataFrame:
    """docs with OUTPUT, from shards written into the shared folder."""
    spark = docs.sparkSession
    write_shards(docs, path := new_path(spark, "shards"), shards, bucket_bytes, seed)
    return read_shards(spark, path, docs)


def _by_key(a, b):
    """Order by (doc_id, tie), nulls first: before the shuffle, so that its result doesn't hang on arrival order."""

    def cmp(x, y, below):
        return F.when(x.isNull() & y.isNull(), below).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(below)

    return cmp(a["doc_id"], b["doc_id"], cmp(a["tie"], b["tie"], F.lit(0)))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_documents(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "bucket")
