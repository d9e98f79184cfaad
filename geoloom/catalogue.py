"""Registered queries of the library and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import expressions as E
from .operators import focal, grid, morphology, mosaic, vector, zonal
from .plans import pipelines
from .sources import listing, rasters

def _zoned(spark, d, truncate_window=False):
    """Zones, and their pixels of the change raster."""
    size = rasters.side(spark, d)
    zones = rasters.zones(spark, d, size)
    return zones, zonal.zone_pixels(zones, rasters.change_segments(spark, d, size), size, size, truncate_window), size


def _zones(spark, d):
    return rasters.zones(spark, d, rasters.side(spark, d))


def _tiles(spark, d):
    return rasters.tiles(spark, d, rasters.side(spark, d))


def _linear(spark, d):
    """The linear raster and its size."""
    size = rasters.linear_size(spark, d)
    return rasters.linear_raster(spark, d, size), size


def _listed(spark, d):
    page = F.col("page_id").cast("string")
    name = F.concat(F.lit("S"), (F.col("page_id") % 9).cast("string"), F.lit("/"), F.element_at(F.split("url", "/"), -1), (F.col("page_id") % 50).cast("string"))
    lines = rasters.read(spark, d, "pages").select("page_id", F.concat(F.lit("  "), page, F.lit(","), name, F.lit("_CHM,x ")).alias("value"))
    return listing.paths_of_lines(lines, keep=("page_id",))


def listing_paths(spark, d):
    return _listed(spark, d).select("path")


def dtm_rewrite(spark, d):
    dtm = E.rewrite_key(F.col("path"), "_CHM", "_DTM.tif")
    return _listed(spark, d).select("path", dtm.alias("dtm"), E.before(F.element_at(F.split(dtm, "/"), -1), "_DTM").alias("survey"), E.stem(F.col("path")).alias("stem"))


def copy_manifest(spark, d):
    return listing.copy_manifest(_listed(spark, d), "/in", "/out/", "page_id")


def tile_keys(spark, d):
    return rasters.places(spark, d).select("id", E.tile_key(F.col("lat_band"), F.col("lon_band")).alias("tile"), E.quadrant(F.col("lat_band"), F.col("lon_band")).alias("quadrant"))


def _wanted_tiles(spark, d):
    """Keys of boxes of 15 degrees at all places, and the catalogue of tiles that have a place."""
    places = rasters.places(spark, d)
    boxes = places.select("id", F.col("lon").alias("xmin"), (F.col("lon") + 15).alias("xmax"), F.col("lat").alias("ymin"), (F.col("lat") + 15).alias("ymax"))
    return mosaic.tile_keys_of(boxes, "id"), places.select(E.tile_key(F.col("lat_band"), F.col("lon_band")).alias("tile")).distinct()


def tiles_for_extent(spark, d):
    return listing.existing(*_wanted_tiles(spark, d), "tile").select("id", "tile")


def tiles_missing(spark, d):
    return listing.missing(*_wanted_tiles(spark, d), "tile")


def hemisphere_tiles(spark, d):
    return mosaic.hemisphere_tiles(spark, "S", "W", _wanted_tiles(spark, d)[1])


def classify_change(spark, d):
    o = rasters.read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, None).otherwise((F.col("o_orderkey") * 13) % 160).cast("double").alias("a"), F.when(F.col("o_orderkey") % 5 == 0, None).otherwise((F.col("o_custkey") * 7) % 160).cast("double").alias("b"))
    return o.groupBy(E.change_class(F.col("a"), F.col("b")).alias("mode")).agg(F.count(F.lit(1)).alias("n"))


def block_grid_halo(spark, d):
    return grid.block_grid(spark, 5000, 3000, 2048, 1024)


def raster_extents(spark, d):
    c = rasters.read(spark, d, "nation").select(F.col("n_name").alias("raster"), (F.col("n_nationkey") * 10.0).alias("x0"), F.lit(0.5).alias("dx"), (F.col("n_nationkey") * -5.0).alias("y0"), F.lit(-0.25).alias("dy"), (F.col("n_nationkey") + 20).alias("cols"), (F.col("n_nationkey") + 8).alias("rows"))
    return rasters.with_extents(c).select("raster", "xmin", "xmax", "ymin", "ymax")


def block_origins(spark, d):
    x, y = E.block_origin(F.col("brow"), F.col("bcol"), 10.0, 0.25, 50.0, -0.5)
    return grid.block_grid(spark, 5000, 3000, 2048, 1024).select("block_id", x.alias("x"), y.alias("y"))


def halo_copies(spark, d):
    """Cells of each block with its halo, and those of the true block."""
    raster, size = _linear(spark, d)
    across = -(-size // 48)
    own = (F.expr("prow div 48") * across + F.expr("pcol div 48")) == F.col("block_id")
    return grid.replicate(raster, size, size, 48, 24).groupBy("block_id").agg(F.count(F.lit(1)).alias("cells"), F.count_if(own).alias("own"))


def output_names(spark, d):
    k, name = F.col("n_nationkey"), F.col("n_name")
    return rasters.read(spark, d, "nation").select(
        k.alias("id"), E.slope_name(name).alias("slope"), E.smoothed_name(name).alias("smoothed"), E.change_name(name).alias("change"), E.training_name(F.concat(F.lit("zone"), k.cast("string")), name).alias("training"),
        E.polygons_name(k).alias("polygons"), E.cropped_name(name, F.lit("zone"), k % 2 == 0).alias("cropped"),
    )


def order_stamps(spark, d):
    return rasters.read(spark, d, "orders").select(E.date_stamp(F.col("o_orderdate")).alias("stamp")).distinct()


def layer_extent(spark, d):
    return rasters.layer_extent(_zones(spark, d))


def zones_in_box(spark, d):
    return rasters.read_box(_zones(spark, d), 20.5, 10.0, 90.25, 70.75).select("zone_id")


def read_windows(spark, d):
    size = rasters.side(spark, d)
    box = {"xmin": F.col("xmin"), "xmax": F.col("xmax"), "ymin": -F.col("ymax"), "ymax": -F.col("ymin")}
    return rasters.zones(spark, d, size).select("zone_id", *[v.cast("int").alias(k) for k, v in E.read_window(box, 0, 1, 0, -1, size, size).items()])


def window_pixels(spark, d):
    return rasters.window(rasters.change_raster(spark, d, rasters.side(spark, d)), 101, 17, 30, 40)


def threshold_mask(spark, d):
    return _linear(spark, d)[0].select("prow", "pcol", E.above(F.col("value"), 15).alias("mask"))


def zonal_pixels(spark, d):
    return _zoned(spark, d)[1].select("zone_id", "prow", "pcol", "value")


def zonal_window_pixels(spark, d):
    return _zoned(spark, d, True)[1].select("zone_id", "prow", "pcol", "value")


def zonal_mode(spark, d):
    return zonal.mode_nonzero(_zoned(spark, d)[1])


def extract_v2_pixels(spark, d):
    return zonal.extract_v2(_zoned(spark, d, True)[1]).select("zone_id", "prow", "pcol", "value")


def extract_v2_status(spark, d):
    zones, zoned, _ = _zoned(spark, d, True)
    return zonal.status(zones, zonal.extract_v2(zoned))


def status_of_inputs(spark, d):
    """As if each seventh of the zones were an input of its own."""
    zones, zoned, _ = _zoned(spark, d, True)
    of = lambda df: df.withColumn("input", F.col("zone_id") % 7)
    return zonal.status(of(zones), of(zonal.extract_v2(zoned)), ["input"])


def extract_v1_natural(spark, d):
    return zonal.extract_v1(_zoned(spark, d)[1], "natural").select("zone_id", "prow", "pcol", "value")


def extract_v1_manmade(spark, d):
    return zonal.extract_v1(_zoned(spark, d)[1], "manmade").select("zone_id", "prow", "pcol", "value")


def _overlay(spark, d):
    _, zoned, size = _zoned(spark, d, True)
    return zonal.overlay(zonal.extract_v2(zoned)), size


def overlay_last_wins(spark, d):
    return _overlay(spark, d)[0]


def block_scatter(spark, d):
    pixels, size = _overlay(spark, d)
    return grid.gather(grid.scatter(pixels, size, size, 64), 64)


def block_scatter_counts(spark, d):
    """Sizes of the blocks that have pixels."""
    pixels, size = _overlay(spark, d)
    return grid.scatter(pixels, size, size, 100).select("block_row", "block_col", "height", "width")


def quadrant_counts(spark, d):
    return mosaic.quadrants(rasters.places(spark, d)).groupBy("quadrant").agg(F.count(F.lit(1)).alias("n"))


def quadrant_mosaics(spark, d):
    """One pixel for each place, by its tile."""
    tile = E.tile_key(F.col("lat_band"), F.col("lon_band"))
    pixels = rasters.places(spark, d).select(tile.alias("tile"), "id", (F.col("id") % 7).cast("int").alias("prow"), (F.col("id") % 5).cast("int").alias("pcol"), (F.col("id") % 256).cast("int").alias("value"))
    return mosaic.quadrant_mosaics(pixels, "id")


def _boxed(rows, side, *columns):
    return rows.select(*columns, *[F.col(c).alias(f"{side}_{c}") for c in ("xmin", "xmax", "ymin", "ymax")])


def bbox_join(spark, d):
    return grid.cell_join(_boxed(_zones(spark, d), "l", "zone_id"), _boxed(_tiles(spark, d), "r", "location"), 32.0).select("zone_id", "location")


def tile_semi_join(spark, d):
    return grid.cell_join(_boxed(_zones(spark, d), "l", "zone_id"), _boxed(_tiles(spark, d), "r", "location"), 32.0, "left_semi").select("zone_id")


def zone_tiles(spark, d):
    zones, tiles = _zones(spark, d), _tiles(spark, d)
    near = grid.cell_join(_boxed(zones, "l", "zone_id"), _boxed(tiles, "r", "location"), 32.0)
    return vector.intersecting(near, zones, tiles, "zone_id", "location")


def tile_list(spark, d):
    return listing.tile_list(pipelines.tiles_of(_zones(spark, d), _tiles(spark, d), "zone_id", 32.0))


def tile_nonblank(spark, d):
    return mosaic.not_blank(mosaic.split_by_tiles(overlay_last_wins(spark, d), _tiles(spark, d)))


def raster_tiles(spark, d):
    return pipelines.raster_tiles(overlay_last_wins(spark, d), _tiles(spark, d)).select("location", "prow", "pcol", "value")


def crop_tiles(spark, d):
    """Two rasters merged and cropped to all tiles but one that is done already."""
    size, tiles = rasters.side(spark, d), _tiles(spark, d)
    out = mosaic.merged_crop(_two(spark, d, size), "ord", tiles, tiles.where("location = 'NATION_7'"))
    return out.groupBy("location").agg(F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total"))


def training_tiles(spark, d):
    size = rasters.side(spark, d)
    out = pipelines.change_training(rasters.zones(spark, d, size), rasters.change_raster(spark, d, size), _tiles(spark, d), "natural", size, size)
    return out.groupBy("zone_id", "location").agg(F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total"))


def slope_deg(spark, d):
    s = focal.slope(rasters.elevation(spark, d))
    return s.select("prow", "pcol", F.round("value", 6).alias("slope"))


def dilate3x3(spark, d):
    return focal.dilate(rasters.elevation(spark, d))


def sum3x3(spark, d):
    return focal.sum3(rasters.change_raster(spark, d, rasters.side(spark, d))).select("prow", "pcol", "value")


def endpoint_count(spark, d):
    ends = focal.endpoints(_linear(spark, d)[0].select("prow", "pcol", E.above(F.col("value"), 40).alias("value")))
    return ends.select("prow", "pcol")


def slope_dilated_mosaic(spark, d):
    dem = rasters.elevation(spark, d)
    two = dem.withColumn("raster_ord", F.lit(1)).unionByName(dem.where("prow % 400 BETWEEN 100 AND 199").withColumn("value", F.col("value") * 2).withColumn("raster_ord", F.lit(2)))
    return pipelines.smoothed_slope(two).select("prow", "pcol", F.round("value", 6).alias("value"))


def _two(spark, d, size):
    """The change raster, and over its upper third a second one with nodata."""
    g = rasters.change_raster(spark, d, size)
    return g.withColumn("ord", F.lit(1)).unionByName(g.where(F.col("prow") < size // 3).withColumn("value", F.when(F.col("value") > 8, F.col("value") + 100).otherwise(255)).withColumn("ord", F.lit(2)))


def mosaic_last_wins(spark, d):
    return mosaic.mosaic(_two(spark, d, rasters.side(spark, d)), "ord")


def components4(spark, d):
    raster, size = _linear(spark, d)
    return morphology.components(raster.where("value > 60"), size, size, block=96)


def _lines(spark, d, threshold=30):
    raster, size = _linear(spark, d)
    return raster.where(F.col("value") > threshold), size


def enclosed_interior(spark, d):
    lines, size = _lines(spark, d)
    return morphology.enclosed(lines, size, size, 96).select("prow", "pcol")


def area_filter(spark, d):
    lines, size = _lines(spark, d)
    return morphology.enclosed(lines, size, size, 96, 3).select("prow", "pcol")


def skeleton(spark, d):
    lines, size = _lines(spark, d)
    return morphology.skeleton(lines, size, size, 48, 24)


def close_gaps(spark, d):
    lines, size = _lines(spark, d)
    return morphology.closed(lines, size, size, 48, 24, 8)


def extract_polygons(spark, d):
    raster, size = _linear(spark, d)
    return pipelines.polygons(raster, size, size, 30, block=48, halo=24, gap=4, min_area=2).select("block_id", "polygon", "area", F.size("rings").alias("n_rings"), F.size(F.col("rings")[0]).alias("n_points"))


def _buffer_lines(spark, d):
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return _zones(spark, d).select(F.col("zone_id").alias("line_id"), F.array(at(F.col("xmin"), F.col("ymin")), at(F.col("xmax") + 0.21, F.col("ymax") + 0.17), at(F.col("xmax") + 6.43, F.col("ymin") + 0.39)).alias("points"))


def buffer_rasterize(spark, d):
    return vector.buffer_lines(_buffer_lines(spark, d), 2.5)


def buffer_tiles(spark, d):
    out = pipelines.line_training(_buffer_lines(spark, d), _tiles(spark, d), 2.5)
    return out.groupBy("location").agg(F.count(F.lit(1)).alias("cells"))


def footprint_mercator(spark, d):
    boxes = vector.footprint_boxes(_zoned(spark, d)[1], "zone_id", -60.0, 0.01, 5.0, -0.01)
    return boxes.select("zone_id", *[F.round(E.mercator_x(F.col(c)), 4).alias(c) for c in ("xmin", "xmax")], *[F.round(E.mercator_y(F.col(c)), 4).alias(c) for c in ("ymin", "ymax")])


def footprint_rings(spark, d):
    """Area and perimeter of the valid-data polygons of all zones, cut at blocks of 100."""
    _, zoned, size = _zoned(spark, d)
    rings = vector.valid_rings(zoned, "zone_id", size, size, 100).select("zone_id", F.explode("rings").alias("r"))
    steps = F.zip_with(F.slice("r", F.lit(1), F.size("r") - 1), F.slice("r", F.lit(2), F.size("r") - 1), lambda a, b: F.struct((a["x"] * b["y"] - b["x"] * a["y"]).alias("twice"), (F.abs(b["x"] - a["x"]) + F.abs(b["y"] - a["y"])).alias("way")))
    total = lambda f: F.aggregate(steps, F.lit(0.0), lambda t, s: t + s[f])
    return rings.groupBy("zone_id").agg(F.abs(F.sum(total("twice")) / 2).alias("area"), F.sum(total("way")).alias("perimeter"))


def reprojected(spark, d):
    """A corner of boxes at places, whose system is EPSG:4326 or already EPSG:3857."""
    p = rasters.places(spark, d)
    rings = E.reproject(rasters.box_rings(F.col("lon"), F.col("lat"), F.col("lon") + 1, F.col("lat") + 1), F.when(F.col("id") % 2 == 0, 3857).otherwise(4326), 3857)
    return p.select("id", rings.alias("r")).select("id", F.round(F.col("r")[0][2]["x"], 4).alias("x"), F.round(F.col("r")[0][2]["y"], 4).alias("y"))


def merged_footprints(spark, d):
    z = _zones(spark, d).select("zone_id", "xmin", "xmax")
    return mosaic.merge_footprints({"a_footprint.fgb": z.where("zone_id % 2 = 0"), "b_x_footprint.fgb": z.where("zone_id % 2 = 1")})


def merged_vectors(spark, d):
    z = _zones(spark, d)
    merged = mosaic.merge_vectors([z.where("zone_id % 2 = 0"), z.where("zone_id % 2 = 1")])
    points = F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r))
    return merged.groupBy(F.size("rings").alias("parts")).agg(F.count(F.lit(1)).alias("features"), F.sum(points).alias("points"))


def warped(spark, d):
    """Nearest pixels of the change raster, in tenths of degrees, on a Mercator grid of 41.2 km."""
    size = rasters.side(spark, d)
    across = size // 4
    target = spark.range(across * across).select((F.col("id") % across).cast("int").alias("tx"), F.expr(f"cast(id div {across} as int)").alias("ty")).withColumns({"cx": (F.col("tx") + 0.5) * 41200, "cy": -(F.col("ty") + 0.5) * 41200})
    return mosaic.resample(rasters.change_raster(spark, d, size), target, E.lon_of_mercator, E.lat_of_mercator, 0.0, 0.1, 0.0, -0.1).select("tx", "ty", "value")


_QUERIES = (
    listing_paths, dtm_rewrite, copy_manifest, tile_keys, tiles_for_extent, tiles_missing, hemisphere_tiles, classify_change, block_grid_halo, block_origins, halo_copies, raster_extents, output_names, order_stamps, layer_extent, zones_in_box, read_windows,
    window_pixels, threshold_mask, zonal_pixels, zonal_window_pixels, zonal_mode, extract_v2_pixels, extract_v2_status, status_of_inputs, extract_v1_natural, extract_v1_manmade, overlay_last_wins, block_scatter, block_scatter_counts, quadrant_counts, quadrant_mosaics,
    bbox_join, tile_semi_join, zone_tiles, tile_list, tile_nonblank, raster_tiles, crop_tiles, training_tiles, slope_deg, dilate3x3, sum3x3, endpoint_count, slope_dilated_mosaic, mosaic_last_wins, components4, enclosed_interior, area_filter,
    skeleton, close_gaps, extract_polygons, buffer_rasterize, buffer_tiles, footprint_mercator, footprint_rings, reprojected, merged_footprints, merged_vectors, warped,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    from .plans.sql import ORACLES

    return dict(ORACLES)
