"""End-to-end pipelines as lazy plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import above
from ..operators import focal, grid, morphology, mosaic, vector, zonal


def change_tiles(features: DataFrame, pixels: DataFrame, cols: int, rows: int) -> DataFrame:
    """v2: zonal extraction, overlay; to be scattered into blocks by grid.scatter."""
    return zonal.overlay(zonal.extract_v2(zonal.zone_pixels(features, pixels, cols, rows)))


def change_training(features: DataFrame, pixels: DataFrame, tiles: DataFrame, change: str, cols: int, rows: int) -> DataFrame:
    """v1: zonal extraction, tiling, blank tiles dropped: zone_id, location, prow, pcol, value."""
    tiled = mosaic.split_by_tiles(zonal.extract_v1(zonal.zone_pixels(features, pixels, cols, rows), change), tiles, ["zone_id"])
    return mosaic.without_blank(tiled, ["zone_id", "location"])


def tiles_of(features: DataFrame, tiles: DataFrame, key: str, cell: float) -> DataFrame:
    """location of tiles that polygons meet, in order."""
    box = lambda d, s, k: d.select(k, *[F.col(c).alias(f"{s}_{c}") for c in ("xmin", "xmax", "ymin", "ymax")])
    near = grid.cell_join(box(features, "l", key), box(tiles, "r", "location"), cell)
    return vector.intersecting(near, features, tiles, key, "location").select("location").distinct().orderBy("location")


def raster_tiles(pixels: DataFrame, tiles: DataFrame) -> DataFrame:
    """Pixels by tile without blank tiles."""
    tiled = mosaic.split_by_tiles(pixels, tiles)
    return tiled.join(F.broadcast(mosaic.not_blank(tiled)), "location", "left_semi")


def line_training(lines: DataFrame, tiles: DataFrame, distance: float) -> DataFrame:
    """Buffered, rasterised lines by tile: location, prow, pcol, value 1; cells outside are 0 and not stored."""
    burnt = vector.buffer_lines(lines, distance).select("prow", "pcol").distinct().withColumn("value", F.lit(1))
    return raster_tiles(burnt, tiles)


def smoothed_slope(rasters: DataFrame, order: str = "raster_ord") -> DataFrame:
    """Slope, 3 x 3 maximum and mosaic of several rasters (raster_ord, prow, pcol, value)."""
    return mosaic.mosaic(focal.dilate(focal.slope(rasters, keys=[order]), [order]), order, nodata=-9999.0)


def polygons(raster: DataFrame, cols: int, rows: int, threshold: float = 15, **options) -> DataFrame:
    return morphology.extract_polygons(raster.where(above(F.col("value"), threshold) == 1), cols, rows, **options)
