"""Command line: python -m geoloom COMMAND ... Rasters are folders of write_raster, layers GeoJSON lines or collections."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expressions as E
from .operators import mosaic, vector, zonal
from .plans import pipelines
from .sources import listing, rasters, vectors


def _layer(spark: SparkSession, path: str, about: dict | None = None) -> DataFrame:
    """A layer, with years as numbers; with about, in a raster's system and pixel space."""
    rows = vectors.read_geojson(spark, path) if path.endswith(".geojson") else vectors.read_geojson_lines(spark, path)
    year = lambda c: F.expr(f"try_cast(properties['{c}'] as double)").alias(c)
    rows = rows.select(F.col("feature_id").alias("zone_id"), F.col("feature_id").alias("ord"), "rings", "srid", "properties", year("year_start"), year("year_end"))
    if about is None:
        return rasters.bounds(rows)
    world = E.reproject(F.col("rings"), F.col("srid"), about["srid"])
    return rasters.bounds(rows.withColumn("rings", E.to_pixels(world, about["x0"], about["dx"], about["y0"], about["dy"])))


def _write(pixels: DataFrame, about: dict, path: str, name: str, nodata: float = 255, dtype: str = "uint8") -> None:
    rasters.write_raster(pixels, path, name, about["cols"], about["rows"], (about["x0"], about["dx"], about["y0"], about["dy"]), about["srid"], nodata, dtype, about["block"])


def copy(spark, args) -> None:
    listing.copy_files(listing.copy_manifest(listing.read_listing(spark, args.listing), args.source, args.target, "line"))


def extract(spark, args) -> None:
    """v2: each raster's change under the layer, a status table, and one mosaic for each quadrant of 10 degree tiles."""
    statuses, tiles = None, None
    for path in args.rasters:
        about = rasters.open_raster(spark, path)
        zones = _layer(spark, args.layer, about)
        zones = rasters.read_box(zones, 0.0, 0.0, float(about["cols"]), float(about["rows"]))
        found = zonal.extract_v2(zonal.zone_pixels(zones, rasters.raster_pixels(spark, path), about["cols"], about["rows"], truncate_window=True))
        one = zonal.status(zones, found).withColumn("unit", F.lit(about["raster"]))
        out = zonal.overlay(found)
        if not out.isEmpty():
            _write(out, about, f"{args.target}/{about['raster']}_change", f"{about['raster']}_change")
        # Cells of one grid for all tiles: rows go down from 90 N, columns go right from 180 W.
        row, col = round((90 - about["y0"]) / -about["dy"]), round((about["x0"] + 180) / about["dx"])
        key = E.tile_key(E.lat_band(F.lit(about["y0"] + about["dy"] / 2)), E.lon_band(F.lit(about["x0"] + about["dx"] / 2)))
        placed = out.select(key.alias("tile"), F.lit(about["raster"]).alias("raster"), (F.col("prow") + row).alias("prow"), (F.col("pcol") + col).alias("pcol"), "value")
        statuses, tiles = (one, placed) if statuses is None else (statuses.unionByName(one), tiles.unionByName(placed))
    statuses.write.mode("overwrite").parquet(f"{args.target}/status")
    mosaic.quadrant_mosaics(tiles, "raster").repartition("quadrant").write.mode("overwrite").partitionBy("quadrant").parquet(f"{args.target}/merged")
    zonal.successes(spark.read.parquet(f"{args.target}/status")).show()


def training(spark, args) -> None:
    """v1: change under the layer by training tile, blank tiles dropped, and the tiles' list."""
    about = rasters.open_raster(spark, args.raster)
    tiles = _layer(spark, args.tiles, about).select(F.col("properties")["location"].alias("location"), "rings", "xmin", "xmax", "ymin", "ymax")
    out = pipelines.change_training(_layer(spark, args.layer, about), rasters.raster_pixels(spark, args.raster), tiles, args.change, about["cols"], about["rows"])
    out.write.mode("overwrite").parquet(f"{args.target}/pixels")
    listing.write_tile_list(spark.read.parquet(f"{args.target}/pixels"), f"{args.target}/tiles")


def planet_tiles(spark, args) -> None:
    about = rasters.open_raster(spark, args.raster)
    valid = rasters.raster_pixels(spark, args.raster).withColumn("zone_id", F.lit(0))
    rings = vector.valid_rings(valid, "zone_id", about["cols"], about["rows"], about["block"], about["nodata"])
    world = E.reproject(E.to_world(F.col("rings"), about["x0"], about["dx"], about["y0"], about["dy"]), F.lit(about["srid"]), 3857)
    parts = rasters.bounds(rings.select(F.col("block_id").alias("zone_id"), world.alias("rings")))
    tiles = rasters.bounds(_layer(spark, args.tiles).select(F.col("properties")["location"].alias("location"), E.reproject(F.col("rings"), F.col("srid"), 3857).alias("rings")))
    listing.write_tile_list(pipelines.tiles_of(parts, tiles, "zone_id", args.cell), args.target)


def slope(spark, args) -> None:
    about = rasters.open_raster(spark, args.raster)
    pixels = rasters.raster_pixels(spark, args.raster).withColumn("raster_ord", F.lit(0))
    _write(pipelines.smoothed_slope(pixels), about, args.target, f"{about['raster']}_smoothed", about["nodata"], "float32")


def footprint(spark, args) -> None:
    layers = {}
    for path in args.rasters:
        about = rasters.open_raster(spark, path)
        rings = vector.valid_rings(rasters.raster_pixels(spark, path).withColumn("part", F.lit(0)), "part", about["cols"], about["rows"], about["block"], about["nodata"])
        world = E.to_world(F.col("rings"), about["x0"], about["dx"], about["y0"], about["dy"])
        layers[f"{about['raster']}_footprint.fgb"] = rings.select(E.reproject(world, F.lit(about["srid"]), 3857).alias("rings"))
    vectors.write_geojson_lines(mosaic.merge_footprints(layers), args.target, ("filename",))


def pastures(spark, args) -> None:
    about = rasters.open_raster(spark, args.raster)
    lines = _layer(spark, args.layer, about).select(F.col("zone_id").alias("line_id"), F.col("rings")[0].alias("points"))
    stamp = spark.range(1).select(E.date_stamp(F.current_date())).first()[0]
    listing.archive(spark, args.target, stamp)  # earlier outputs are kept beside the new ones
    burnt = vector.buffer_lines(lines, args.distance / about["dx"]).select("prow", "pcol").distinct().withColumn("value", F.lit(1))
    _write(burnt.where(F.col("prow").between(0, about["rows"] - 1) & F.col("pcol").between(0, about["cols"] - 1)), about, args.target, "pastures")


def polygons(spark, args) -> None:
    about = rasters.open_raster(spark, args.raster)
    found = pipelines.polygons(rasters.raster_pixels(spark, args.raster), about["cols"], about["rows"], args.threshold, block=args.block, halo=args.halo, gap=args.gap, min_area=args.min_area)
    world = found.withColumn("rings", E.to_world(F.col("rings"), about["x0"], about["dx"], about["y0"], about["dy"]))
    vectors.write_geojson_lines(world, args.target, ("block_id", "polygon", "area"))


#: Command, function, positional arguments (one ending in * takes several), options with their defaults.
COMMANDS = (
    ("copy", copy, ("listing", "source", "target"), {}), ("extract", extract, ("layer", "target", "rasters*"), {}), ("training", training, ("raster", "layer", "tiles", "change", "target"), {}),
    ("planet-tiles", planet_tiles, ("raster", "tiles", "target"), {"cell": 20000.0}), ("slope", slope, ("raster", "target"), {}), ("footprint", footprint, ("target", "rasters*"), {}),
    ("pastures", pastures, ("raster", "layer", "target"), {"distance": 10.0}), ("polygons", polygons, ("raster", "target"), {"threshold": 15.0, "block": 2048, "halo": 1024, "gap": 80.0, "min_area": 80}),
)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="geoloom", description=__doc__)
    commands = parser.add_subparsers(required=True)
    for name, function, positional, options in COMMANDS:
        command = commands.add_parser(name, help=function.__doc__)
        command.set_defaults(run=function)
        for x in positional:
            command.add_argument(x.rstrip("*"), **({"nargs": "+"} if x.endswith("*") else {}))
        for x, default in options.items():
            command.add_argument(f"--{x.replace('_', '-')}", type=type(default), default=default)
    args = parser.parse_args(argv)
    args.run(spark or SparkSession.builder.appName("geoloom").getOrCreate(), args)


if __name__ == "__main__":
    main()
