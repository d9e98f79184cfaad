"""What all operators of this subpackage share: shared storage, table access and small column helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete, materialise, new_path, release, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark only, so any file system that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modest_batches(spark: SparkSession) -> SparkSession:
    """The session, which now hands rows to Python in Arrow batches of a few megabytes; smaller settings stay.

    A batch is held by the JVM outside its heap and by the Python worker, in both directions. Queries and the
    pipeline's stages, which are applications, call this; operators leave the session as it is.
    """
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most, read in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000, int), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20, size)):
        if not 0 < read(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))
    return spark


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id written as text; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
