"""Listings, layers and rasters in files, and the command line on them."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.__main__ import main
from geoloom.functions import expressions as E
from geoloom.operators import zonal
from geoloom.sources import listing, rasters, shared, vectors


def at(folder, name=""):
    return f"file://{folder}/{name}"


def test_folders(spark, tmp_path):
    for name in ("b.tif", "a.tif", "c.TIF", "d.GeoJson", "e.geojson", "f.txt"):
        (tmp_path / name).write_text("x")
    names = lambda df: [r.path.rsplit("/", 1)[1] for r in df.collect()]
    assert names(listing.files(spark, at(tmp_path), ".tif")) == ["a.tif", "b.tif"]
    assert names(listing.files(spark, at(tmp_path), ".geojson", ignore_case=True)) == ["d.GeoJson", "e.geojson"]
    assert len(names(listing.files(spark, at(tmp_path)))) == 6


def test_copies_in_order_of_the_listing(spark, tmp_path):
    (tmp_path / "in/z").mkdir(parents=True)
    (tmp_path / "in/b").mkdir()
    (tmp_path / "in/z/a.tif").write_text("from z")
    (tmp_path / "in/b/a.tif").write_text("from b")
    (tmp_path / "out").mkdir()
    (tmp_path / "l.csv").write_text("id,name\n1,z/a\n2,b/a\n")
    main(["copy", at(tmp_path, "l.csv"), at(tmp_path, "in"), at(tmp_path, "out")], spark)
    assert (tmp_path / "out/a.tif").read_text() == "from b"


def test_archive(spark, tmp_path):
    (tmp_path / "run").mkdir()
    (tmp_path / "run/x").write_text("1")
    assert listing.archive(spark, at(tmp_path, "run"), "jan05_2024").endswith("Previous_versions/run_jan05_2024")
    assert (tmp_path / "Previous_versions/run_jan05_2024/x").read_text() == "1" and listing.archive(spark, at(tmp_path, "run"), "jan06_2024") is None


def test_tile_list(spark, tmp_path):
    listing.write_tile_list(spark.createDataFrame([("b",), ("a",), ("b",)], "location string"), at(tmp_path, "t"))
    (part,) = (tmp_path / "t").glob("*.csv")
    assert part.read_text() == "location\na\nb\n"


def test_date_stamp(spark):
    assert spark.range(1).select(E.date_stamp(F.to_date(F.lit("2024-01-05")))).first()[0] == "jan05_2024"


SQUARE = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
HOLE = [[1, 1], [1, 2], [2, 2], [1, 1]]


def test_geojson(spark, tmp_path):
    kinds = [("Polygon", [SQUARE, HOLE]), ("MultiPolygon", [[SQUARE], [HOLE]]), ("LineString", [[0, 1], [2.5, 3]]), ("Point", [7, 8])]
    features = [{"type": "Feature", "properties": {"n": k, "name": kind}, "geometry": {"type": kind, "coordinates": c}} for k, (kind, c) in enumerate(kinds)]
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [*features, {"type": "Feature", "properties": {}, "geometry": None}]}, indent=1))
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, features)))
    for layer in (vectors.read_geojson(spark, at(tmp_path, "c.geojson")), vectors.read_geojson_lines(spark, at(tmp_path, "l.json"))):
        got = {r.kind: ([[[p.x, p.y] for p in ring] for ring in r.rings], r.properties["n"], r.xmax) for r in layer.collect()}
        assert got == {"Polygon": ([SQUARE, HOLE], "0", 4.0), "MultiPolygon": ([SQUARE, HOLE], "1", 4.0), "LineString": ([[[0, 1], [2.5, 3]]], "2", 2.5), "Point": ([[[7, 8]]], "3", 7.0)}
    layer = vectors.read_geojson(spark, at(tmp_path, "c.geojson")).where("kind = 'Polygon'")
    vectors.write_geojson_lines(layer.withColumn("name", F.col("properties")["name"]), at(tmp_path, "out"), ("name",))
    (r,) = vectors.read_geojson_lines(spark, at(tmp_path, "out")).collect()
    assert ([[[p.x, p.y] for p in ring] for ring in r.rings], r.properties) == ([SQUARE, HOLE], {"name": "Polygon"})
    assert rasters.layer_extent(layer).first() == (0.0, 4.0, 0.0, 4.0) and rasters.read_box(layer, 4.0, 4.0, 9.0, 9.0).count() == 1 and rasters.read_box(layer, 4.1, 0.0, 9.0, 9.0).count() == 0


def test_box_reaches_the_scan(spark, tmp_path, capsys):
    spark.range(5).select("id", *[F.col("id").cast("double").alias(c) for c in ("xmin", "xmax", "ymin", "ymax")]).write.parquet(at(tmp_path, "l"))
    rasters.read_box(spark.read.parquet(at(tmp_path, "l")), 1.0, 1.0, 2.0, 2.0).explain()
    assert "GreaterThanOrEqual(xmax,1.0)" in capsys.readouterr().out.split("PushedFilters")[1]


def test_rasters_in_files(spark, tmp_path):
    cells = [(r, c, r * 7 + c) for r in range(30) for c in range(25) if (r + c) % 3]
    pixels = spark.createDataFrame(cells, "prow int, pcol int, value int")
    rasters.write_raster(pixels, at(tmp_path, "r"), "one", 25, 30, (10.0, 0.5, 40.0, -0.25), block=8)
    about = rasters.open_raster(spark, at(tmp_path, "r"))
    assert (about["cols"], about["rows"], about["xmax"], about["ymin"], about["nodata"]) == (25, 30, 22.5, 32.5, 255.0)
    assert {tuple(r) for r in rasters.raster_pixels(spark, at(tmp_path, "r")).collect()} == {(r, c, v % 256) for r, c, v in cells if v % 256 != 255}
    some = rasters.raster_pixels(spark, at(tmp_path, "r"), (5, 9, 6, 11))
    assert {tuple(r) for r in some.collect()} == {(r, c, v) for r, c, v in cells if 9 <= r < 20 and 5 <= c < 11}
    floats = pixels.withColumn("value", F.col("value") / 4)
    rasters.write_raster(floats, at(tmp_path, "f"), "two", 25, 30, (10.0, 0.5, 40.0, -0.25), nodata=-9999, dtype="float32", block=8)
    assert {tuple(r) for r in rasters.raster_pixels(spark, at(tmp_path, "f")).collect()} == {(r, c, v / 4) for r, c, v in cells}


def test_reprojection_of_other_systems_is_an_error(spark):
    rows = spark.createDataFrame([([[(1.0, 2.0)]], 32633)], "rings array<array<struct<x:double,y:double>>>, srid int")
    with pytest.raises(Exception, match="cannot convert EPSG:32633"):
        rows.select(E.reproject(F.col("rings"), F.col("srid"), 3857)).collect()
    with pytest.raises(ValueError):
        E.reproject(F.col("rings"), F.col("srid"), 32633)


def test_v1_years_that_are_nan(spark):
    nan = float("nan")
    zoned = spark.createDataFrame([(1, 1, 0, i, v, nan, nan) for i, v in enumerate([0, 5, 7, 5])], "zone_id long, ord long, prow int, pcol int, value int, year_start double, year_end double")
    run = lambda kind: [r.value for r in zonal.extract_v1(zoned, kind).orderBy("pcol").collect()]
    assert run("natural") == [0, 5, 0, 5] and run("manmade") == [0, 5, 7, 5]
    with pytest.raises(Exception, match="one of year_start"):
        zonal.extract_v1(zoned.withColumn("year_end", F.lit(9.0)), "natural").collect()


def test_windows_over_edges(spark):
    boxes = spark.createDataFrame([(-3.0, 2.0, -260.0, -250.0), (255.9, 300.0, -1.2, 9.0), (3.2, 3.3, -4.4, -4.1)], "xmin double, xmax double, ymin double, ymax double")
    window = E.read_window({c: F.col(c) for c in boxes.columns}, 0, 1, 0, -1, 256, 256)
    assert [tuple(r) for r in boxes.select(*[v.alias(k) for k, v in window.items()]).collect()] == [(0, 250, 2, 6), (255, 0, 1, 2), (3, 4, 1, 1)]


def test_shared_folder(spark):
    assert shared.shared_dir(spark).startswith("file:") and shared.materialise(spark.range(3), "x").count() == 3


def test_commands(spark, tmp_path):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 12, (40, 50))
    pixels = spark.createDataFrame([(r, c, int(values[r, c])) for r in range(40) for c in range(50)], "prow int, pcol int, value int")
    rasters.write_raster(pixels, at(tmp_path, "change"), "00N_060W", 50, 40, (-60.0, 0.1, 0.0, -0.1), block=16)
    ring = [[-59.5, -0.5], [-57, -0.6], [-57.2, -3], [-59.4, -2.7], [-59.5, -0.5]]
    feature = lambda properties, kind, c: json.dumps({"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": c}})
    (tmp_path / "zones").write_text(feature({"year_start": 3, "year_end": 9}, "Polygon", [ring]))
    (tmp_path / "tiles").write_text("\n".join(feature({"location": f"t{k}"}, "Polygon", [[[-60 + 2.5 * k, 0], [-57.5 + 2.5 * k, 0], [-57.5 + 2.5 * k, -4], [-60 + 2.5 * k, -4], [-60 + 2.5 * k, 0]]]) for k in range(3)))
    main(["extract", at(tmp_path, "zones"), at(tmp_path, "out"), at(tmp_path, "change")], spark)
    (status,) = spark.read.parquet(at(tmp_path, "out/status")).collect()
    assert (status.status, status.polygon_count, status.unit) == ("success", 1, "00N_060W")
    inside = rasters.raster_pixels(spark, at(tmp_path, "out/00N_060W_change")).collect()
    assert len(inside) == status.pixel_count > 200 and all(r.value == values[r.prow, r.pcol] in (0, *range(3, 10)) for r in inside)
    merged = spark.read.parquet(at(tmp_path, "out/merged")).collect()
    assert {(r.prow - 900, r.pcol - 1200, r.value) for r in merged} == {tuple(r) for r in inside} and {r.quadrant for r in merged} == {"NW"}
    main(["training", at(tmp_path, "change"), at(tmp_path, "zones"), at(tmp_path, "tiles"), "natural", at(tmp_path, "train")], spark)
    assert {r.location for r in spark.read.parquet(at(tmp_path, "train/pixels")).collect()} == {"t0", "t1"}
    main(["planet-tiles", at(tmp_path, "change"), at(tmp_path, "tiles"), at(tmp_path, "list")], spark)
    assert [r.location for r in spark.read.csv(at(tmp_path, "list"), header=True).collect()] == ["t0", "t1"] or [r.location for r in spark.read.csv(at(tmp_path, "list"), header=True).collect()] == ["t0", "t1", "t2"]
    main(["footprint", at(tmp_path, "feet"), at(tmp_path, "change")], spark)
    feet = vectors.read_geojson_lines(spark, at(tmp_path, "feet"), 3857).collect()
    assert {r.properties["filename"] for r in feet} == {"00N_060W"} and abs(min(r.xmin for r in feet) - np.radians(-60) * 6378137) < 1e-3
    main(["slope", at(tmp_path, "change"), at(tmp_path, "slope")], spark)
    assert rasters.open_raster(spark, at(tmp_path, "slope"))["dtype"] == "float32" and rasters.raster_pixels(spark, at(tmp_path, "slope")).count() == 2000
    (tmp_path / "lines").write_text(feature({}, "LineString", [[-59, -1], [-56, -2]]))
    for _ in range(2):
        main(["pastures", at(tmp_path, "change"), at(tmp_path, "lines"), at(tmp_path, "past"), "--distance", "0.25"], spark)
    assert rasters.raster_pixels(spark, at(tmp_path, "past")).count() > 100 and list(tmp_path.glob("Previous_versions/past_*"))
    main(["polygons", at(tmp_path, "change"), at(tmp_path, "poly"), "--threshold", "6", "--block", "16", "--halo", "8", "--gap", "3", "--min-area", "2"], spark)
    assert vectors.read_geojson_lines(spark, at(tmp_path, "poly")).where("xmin < -60 OR xmax > -55 OR ymax > 0 OR ymin < -4").count() == 0
