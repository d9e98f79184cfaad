"""Vector layers: GeoJSON in and out, as rings and attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rasters import bounds

FEATURE = "type string, properties map<string, string>, geometry struct<type: string, coordinates: string>"
COLLECTION = "type string, features array<struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"


def _rings(kind, coordinates):
    """Rings of polygons and of multipolygons' parts, lines as one open ring, points as a ring of one corner; others are null."""
    deep = lambda levels: F.from_json(coordinates, "array<" * levels + "double" + ">" * levels)
    corner = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    of = lambda lines: F.transform(lines, lambda line: F.transform(line, corner))
    return (
        F.when(kind == "Polygon", of(deep(3))).when(kind == "MultiPolygon", of(F.flatten(deep(4)))).when(kind == "MultiLineString", of(deep(3)))
        .when(kind == "LineString", of(F.array(deep(2)))).when(kind == "Point", of(F.array(F.array(deep(1)))))
    )


def _features(raw: DataFrame, srid: int) -> DataFrame:
    g = F.col("geometry")
    rows = raw.where(g.isNotNull()).select(F.monotonically_increasing_id().alias("feature_id"), g["type"].alias("kind"), _rings(g["type"], g["coordinates"]).alias("rings"), "properties", F.lit(srid).alias("srid"))
    return bounds(rows)


def read_geojson(spark: SparkSession, path: str, srid: int = 4326) -> DataFrame:
    """feature_id, kind, rings, properties, srid and envelope of the features of FeatureCollection files."""
    files = spark.read.schema(COLLECTION).json(path, multiLine=True)
    return _features(files.select(F.explode("features").alias("f")).select("f.*"), srid)


def read_geojson_lines(spark: SparkSession, path: str, srid: int = 4326) -> DataFrame:
    """The same of files with a feature on each line, which are read in parallel."""
    return _features(spark.read.schema(FEATURE).json(path), srid)


def geojson_lines(features: DataFrame, properties: tuple[str, ...] = ()) -> DataFrame:
    """value: a GeoJSON feature for each row; rings are written as one polygon, the first being its outer ring."""
    corners = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    held = F.struct(*[F.col(c) for c in properties]) if properties else F.create_map().cast("map<string,string>")
    return features.select(F.to_json(F.struct(F.lit("Feature").alias("type"), held.alias("properties"), F.struct(F.lit("Polygon").alias("type"), corners.alias("coordinates")).alias("geometry"))).alias("value"))


def write_geojson_lines(features: DataFrame, path: str, properties: tuple[str, ...] = ()) -> None:
    geojson_lines(features, properties).write.mode("overwrite").text(path)
