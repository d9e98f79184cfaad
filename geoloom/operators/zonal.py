"""Zonal extraction of change years, in both semantics, and overlay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import change_class, manmade, number_or_null, read_window
from .vector import clipped_spans


SEGMENT = 16


def zone_pixels(features: DataFrame, pixels: DataFrame, cols: int | None = None, rows: int | None = None, truncate_window: bool = False) -> DataFrame:
    """zone_id, ord, prow, pcol, value, year_start, year_end: zones' spans of columns and the pixels within them.

    Spans and pixels meet by row and segment of columns; a span is not spread into pixels first. Both grow, and Spark's
    guess of exploded rows is far too low, so neither is broadcast.
    pixels: prow, pcol and value, or whole segments: prow, segment and cells, an array of SEGMENT values.
    truncate_window: only pixels of the window that is read for a zone's envelope, which may miss its last column or row.
    """
    about = ["ord", "year_start", "year_end"]
    if not truncate_window:
        s = clipped_spans(features, "zone_id", cols, rows, about)
    else:
        # Pixel space has rows downwards: the raster's y is minus the row.
        box = {"xmin": F.col("xmin"), "xmax": F.col("xmax"), "ymin": -F.col("ymax"), "ymax": -F.col("ymin")}
        read = read_window(box, 0, 1, 0, -1, cols, rows)
        ends = {"end_col": read["col_off"] + read["win_cols"], "end_row": read["row_off"] + read["win_rows"]}
        s = clipped_spans(features.withColumns(ends), "zone_id", cols, rows, (*about, *ends))
        s = s.where("prow < end_row").withColumn("last", F.least("last", F.col("end_col").cast("int") - 1)).where("first <= last")
    cut = s.select("zone_id", *about, "prow", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / SEGMENT), F.floor(F.col("last") / SEGMENT))).alias("segment"))
    out = ["zone_id", "ord", "prow", "pcol", "value", "year_start", "year_end"]
    if "cells" in pixels.columns:
        base = (F.col("segment") * SEGMENT).cast("int")
        low, high = F.greatest("first", base), F.least("last", base + SEGMENT - 1)
        met = cut.join(pixels.select("prow", "segment", "cells").hint("merge"), ["prow", "segment"]).withColumn("low", low)
        return met.select("zone_id", *about, "prow", "low", F.posexplode(F.slice("cells", low - base + 1, high - low + 1)).alias("k", "value")).withColumn("pcol", F.col("low") + F.col("k")).select(*out)
    placed = pixels.select("prow", "pcol", "value", F.floor(F.col("pcol") / SEGMENT).alias("segment"))
    found = cut.join(placed.hint("merge"), ["prow", "segment"]).where(F.col("pcol").between(F.col("first"), F.col("last")))
    return found.select(*out)


def mode_nonzero(zoned: DataFrame) -> DataFrame:
    """zone_id and mode of its nonzero values, the smallest of several; zones without any are missing."""
    counts = zoned.where("value <> 0").groupBy("zone_id", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("zone_id").agg(F.max_by("value", F.struct("n", -F.col("value"))).alias("mode"))


def with_mode(zoned: DataFrame) -> DataFrame:
    """All pixels with mode: mode_nonzero of their zone, null without any. Pixels are read once, and dealt out by zone."""
    each, zone = Window.partitionBy("zone_id", "value"), Window.partitionBy("zone_id")
    counted = zoned.repartition("zone_id").withColumn("n", F.count(F.lit(1)).over(each))
    best = F.max(F.when(F.col("value") != 0, F.struct("n", (-F.col("value")).alias("less"), "value"))).over(zone)
    return counted.withColumn("best", best).withColumn("mode", F.col("best.value")).drop("n", "best")


def extract_v2(zoned: DataFrame) -> DataFrame:
    """Kept pixels of each zone, manmade years shifted by 100; others are dropped. Only zones without years need a mode."""
    v, a, b = F.col("value"), F.col("year_start"), F.col("year_end")
    marked = zoned.withColumn("kind", change_class(a, b))
    own = with_mode(marked.where("kind = 'null_both'")).where(F.col("mode").isNotNull() & ((v == F.col("mode")) | (v == 0)))
    keep = (
        F.when(F.col("kind") == "natural", v.between(a, b) | (v == 0))
        .when(F.col("kind") == "extract_all", v.between(1, 24) | (v == 0))
        .when(F.col("kind") == "manmade", v.between(a - 100, b - 100) | (v == 0))
        .otherwise(False)
    )
    both = marked.where(F.col("kind").isin("natural", "extract_all", "manmade") & keep).unionByName(own.drop("mode"))
    out = F.when(F.col("kind").isin("extract_all", "manmade"), manmade(v)).otherwise(v).cast("int")
    return both.select("zone_id", "ord", "prow", "pcol", out.alias("value"))


def overlay(extracted: DataFrame) -> DataFrame:
    """One value for each pixel: that of the zone with the largest ord."""
    return extracted.groupBy("prow", "pcol").agg(F.max_by("value", "ord").alias("value"))


def extract_v1(zoned: DataFrame, change: str) -> DataFrame:
    """All pixels of each zone; values that don't match are 0. change: natural or manmade. NaN years are null."""
    if change not in ("natural", "manmade"):
        raise ValueError(f"change is natural or manmade, not {change}")
    v, a, b = F.col("value"), number_or_null(F.col("year_start")), number_or_null(F.col("year_end"))
    checked = zoned.where(F.assert_true(a.isNull() == b.isNull(), "one of year_start and year_end is null").isNull())
    within = F.when(v.between(a, b), v).otherwise(0)
    if change == "natural":
        own = with_mode(checked.where(a.isNull())).withColumn("value", F.when(v == F.col("mode"), v).otherwise(0)).drop("mode")
        both = checked.where(a.isNotNull()).withColumn("value", within).unionByName(own)
    else:
        both = checked.withColumn("value", F.when(a.isNull(), v).otherwise(within))
    return both.select("zone_id", "ord", "prow", "pcol", v.cast("int").alias("value"))


def status(features: DataFrame, extracted: DataFrame, keys: list[str] = ()) -> DataFrame:
    """A row for each input (keys; one row without): status, polygons, contributing polygons and pixels."""
    marked = features.select(*keys, F.lit(1).alias("polygon"), F.lit(None).cast("long").alias("zone_id"), F.lit(None).cast("int").alias("prow"), F.lit(None).cast("int").alias("pcol"))
    both = marked.unionByName(extracted.select(*keys, F.lit(None).cast("int").alias("polygon"), F.col("zone_id").cast("long").alias("zone_id"), "prow", "pcol"))
    counts = both.groupBy(*keys).agg(F.count("polygon").alias("polygon_count"), F.count_distinct("zone_id").alias("contributing"), F.count_distinct("prow", "pcol").alias("pixel_count"))
    name = F.when(F.col("polygon_count") == 0, "skipped").when(F.col("pixel_count") == 0, "no_change").otherwise("success")
    return counts.select(*keys, name.alias("status"), "polygon_count", "contributing", "pixel_count")


def successes(statuses: DataFrame) -> DataFrame:
    """One row: inputs, and those that succeeded."""
    return statuses.agg(F.count(F.lit(1)).alias("inputs"), F.count_if(F.col("status") == "success").alias("succeeded"))
