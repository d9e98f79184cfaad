"""Text listings, folders and tile lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def paths_of_lines(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Second comma field of each non-blank line, with .tif, and columns to keep; a line with one field is an error."""
    value = F.regexp_replace(column, r"^\s+|\s+$", "")
    return lines.where(F.length(value) > 0).select(F.concat(F.split(value, ",")[1], F.lit(".tif")).alias("path"), *keep)


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """path and line (in order) of a headed listing; quotes and inner blanks are data."""
    rows = spark.read.csv(path, header=True, sep="\x01", quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return paths_of_lines(rows.toDF("value").withColumn("line", F.monotonically_increasing_id()), keep=("line",))


def files(spark: SparkSession, folder: str, suffix: str = "", ignore_case: bool = False) -> DataFrame:
    """path and length of the files of a folder, in order."""
    found = spark.read.format("binaryFile").load(folder).select("path", "length")
    name = F.lower("path") if ignore_case else F.col("path")
    return (found.where(name.endswith(suffix.lower() if ignore_case else suffix)) if suffix else found).orderBy("path")


def copy_manifest(paths: DataFrame, source: str, target: str, order: str) -> DataFrame:
    """src and dst of flat copies; of equal base names the path last in order wins, as if it were copied over the others."""
    flat = paths.select(F.col(order).alias("at"), F.concat(F.lit(source.rstrip("/") + "/"), "path").alias("src"), F.concat(F.lit(target.rstrip("/") + "/"), F.element_at(F.split("path", "/"), -1)).alias("dst"))
    return flat.groupBy("dst").agg(F.max_by("src", F.struct("at", "src")).alias("src")).select("src", "dst")


def copy_files(manifest: DataFrame) -> None:
    """Copy through Hadoop file systems, row by row on the driver: the manifest is a control table."""
    spark = manifest.sparkSession
    hadoop, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    for src, dst in manifest.toLocalIterator():
        a, b = jvm.org.apache.hadoop.fs.Path(src), jvm.org.apache.hadoop.fs.Path(dst)
        jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(hadoop), a, b.getFileSystem(hadoop), b, False, True, hadoop)


def tile_list(rows: DataFrame, column: str = "location") -> DataFrame:
    return rows.select(F.col(column).alias("location")).distinct().orderBy("location")


def write_tile_list(rows: DataFrame, path: str, column: str = "location") -> None:
    tile_list(rows, column).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def existing(keys: DataFrame, catalog: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in the catalogue; others are skipped without a word."""
    return keys.join(catalog.select(on), on, "left_semi")


def missing(keys: DataFrame, catalog: DataFrame, on: str) -> DataFrame:
    """Distinct keys that the catalogue lacks, for a warning."""
    return keys.select(on).join(catalog.select(on), on, "left_anti").distinct()


def archive(spark: SparkSession, folder: str, stamp: str) -> str | None:
    """Moves a folder of earlier outputs into Previous_versions/<stamp> beside it; the new place, if there was a folder."""
    hadoop, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    was = jvm.org.apache.hadoop.fs.Path(folder.rstrip("/"))
    system = was.getFileSystem(hadoop)
    if not system.exists(was):
        return None
    shelf = jvm.org.apache.hadoop.fs.Path(was.getParent(), "Previous_versions")
    system.mkdirs(shelf)
    to = jvm.org.apache.hadoop.fs.Path(shelf, f"{was.getName()}_{stamp}")
    if not system.rename(was, to):
        raise OSError(f"cannot move {folder} to {to}")
    return to.toString()
