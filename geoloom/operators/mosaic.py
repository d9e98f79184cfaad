"""Mosaics, tilings and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import BLANK, lat_band, lon_band, quadrant, tile_key


def mosaic(pixels: DataFrame, order: str, keys: list[str] = (), nodata: float = 255) -> DataFrame:
    """One value for each cell: of the source with the largest order that has data there."""
    return pixels.where(F.col("value") != nodata).groupBy(*keys, "prow", "pcol").agg(F.max_by("value", order).alias("value"))


def quadrants(tiles: DataFrame) -> DataFrame:
    """Tiles (lat_band, lon_band) with their quadrant; lat 0..80 and lon 0..180 exist."""
    return tiles.where(F.col("lat_band").between(-80, 80) & F.col("lon_band").between(-180, 180)).withColumn("quadrant", quadrant(F.col("lat_band"), F.col("lon_band")))


def split_by_tiles(pixels: DataFrame, tiles: DataFrame, keys: list[str] = (), cell: int = 32) -> DataFrame:
    """Pixels by tile location (envelopes in pixel space, half-open at centres): an equi-join on grid cells."""
    low, high = lambda a: F.ceil(F.col(f"{a}min") - 0.5).cast("int"), lambda a: (F.ceil(F.col(f"{a}max") - 0.5) - 1).cast("int")
    boxes = tiles.select("location", *[f(a).alias(f"{n}{a}") for a in "xy" for n, f in (("low", low), ("high", high))]).where("lowx <= highx AND lowy <= highy")
    span = lambda a: F.explode(F.sequence(F.floor(F.col(f"low{a}") / cell), F.floor(F.col(f"high{a}") / cell)))
    cells = boxes.withColumn("cy", span("y")).withColumn("cx", span("x"))
    placed = pixels.withColumns({"cy": F.floor(F.col("prow") / cell), "cx": F.floor(F.col("pcol") / cell)})
    inside = F.col("pcol").between(F.col("lowx"), F.col("highx")) & F.col("prow").between(F.col("lowy"), F.col("highy"))
    return placed.join(cells, ["cy", "cx"]).where(inside).select(*keys, "location", "prow", "pcol", "value")


def not_blank(tiled: DataFrame, keys: list[str] = ("location",)) -> DataFrame:
    """Keys of tiles with a value other than 0 and 255."""
    return tiled.groupBy(*keys).agg(F.bool_or(~F.col("value").isin(*BLANK)).alias("some")).where("some").select(*keys)


def without_blank(tiled: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels of the tiles that not_blank names: pixels are read once and dealt out by keys, which may be many."""
    some = F.bool_or(~F.col("value").isin(*BLANK)).over(Window.partitionBy(*keys))
    return tiled.withColumn("some", some).where("some").drop("some")


def crop(pixels: DataFrame, cutline: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """location, prow, pcol, value within each cutline polygon's envelope; locations that are done already are skipped."""
    wanted = cutline if done is None else cutline.join(done.select("location"), "location", "left_anti")
    return split_by_tiles(pixels, wanted)


def merged_crop(rasters: DataFrame, order: str, cutline: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Several rasters merged on the way (the last with data wins), then cropped."""
    return crop(mosaic(rasters, order), cutline, done)


def tile_keys_of(features: DataFrame, key: str = "zone_id") -> DataFrame:
    """key and tile: names of all 10 degree tiles that features' envelopes (degrees) touch, by generated keys."""
    lat = F.explode(F.sequence(lat_band(F.col("ymax")), lat_band(F.col("ymin")), F.lit(-10))).alias("lat")
    lon = F.sequence(lon_band(F.col("xmin")), lon_band(F.col("xmax")), F.lit(10)).alias("lons")
    return features.select(key, lat, lon).withColumn("lon", F.explode("lons")).select(key, tile_key(F.col("lat"), F.col("lon")).alias("tile"))


def hemisphere_tiles(spark: SparkSession, north: str, east: str, catalog: DataFrame) -> DataFrame:
    """Names of the tiles of a quadrant (N or S, E or W) that the catalogue's `tile` has, in order: 0 to 80 by 0 to 180."""
    steps = spark.range(9 * 19).select((F.expr("id div 19") * 10).cast("int").alias("lat"), (F.col("id") % 19 * 10).cast("int").alias("lon"))
    name = F.format_string("%02d%s_%03d%s", F.col("lat"), F.lit(north), F.col("lon"), F.lit(east)).alias("tile")
    return steps.select(name).join(catalog.select("tile"), "tile", "left_semi").orderBy("tile")


def quadrant_mosaics(pixels: DataFrame, order: str, nodata: float = 255) -> DataFrame:
    """One mosaic for each quadrant of tiles (tile name, prow, pcol within the whole grid, value): quadrant, prow, pcol, value."""
    name = F.concat(F.substring("tile", 3, 1), F.substring("tile", -1, 1))
    return mosaic(pixels.withColumn("quadrant", name), order, ["quadrant"], nodata)


def resample(source: DataFrame, target: DataFrame, to_x, to_y, x0: float, dx: float, y0: float, dy: float) -> DataFrame:
    """Nearest source pixel of target cells (cx, cy: centres): to_x and to_y map them to the source's system."""
    at = target.withColumns({"prow": F.floor((to_y(F.col("cy")) - y0) / dy).cast("int"), "pcol": F.floor((to_x(F.col("cx")) - x0) / dx).cast("int")})
    return at.join(source, ["prow", "pcol"]).drop("prow", "pcol")


def merge_vectors(layers: list[DataFrame]) -> DataFrame:
    """Union of layers' rings; attributes are dropped."""
    out = layers[0].select("rings")
    for layer in layers[1:]:
        out = out.unionByName(layer.select("rings"))
    return out


def merge_footprints(layers: dict[str, DataFrame]) -> DataFrame:
    """Union of footprints with their raster's name as filename."""
    out = None
    for name, layer in layers.items():
        named = layer.withColumn("filename", F.lit(name.split("_footprint.fgb")[0]))
        out = named if out is None else out.unionByName(named)
    return out
