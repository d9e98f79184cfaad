"""Column expressions: keys, names, classes, byte arithmetic and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0
BLANK = (0, 255)


def number_or_null(x: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(x), x)


def change_class(first: Column, last: Column) -> Column:
    """null_both, extract_all, natural, manmade or skip of a polygon's years; a single null or NaN is skip."""
    a, b = number_or_null(first), number_or_null(last)
    return (
        F.when(a.isNull() & b.isNull(), "null_both")
        .when(a.isNull() | b.isNull(), "skip")
        .when((a == 100) & (b == 100), "extract_all")
        .when((a < 100) & (b < 100), "natural")
        .when((a > 100) & (b > 100), "manmade")
        .otherwise("skip")
    )


def lat_band(y: Column) -> Column:
    """Upper edge of the 10 degree band."""
    return (F.ceil(y / 10) * 10).cast("int")


def lon_band(x: Column) -> Column:
    return (F.floor(x / 10) * 10).cast("int")


def tile_key(lat: Column, lon: Column) -> Column:
    """Name of a 10 degree tile, as 10N_060W."""
    return F.format_string("%02d%s_%03d%s", F.abs(lat), F.when(lat >= 0, "N").otherwise("S"), F.abs(lon), F.when(lon >= 0, "E").otherwise("W"))


def quadrant(lat: Column, lon: Column) -> Column:
    return F.concat(F.when(lat >= 0, "N").otherwise("S"), F.when(lon >= 0, "E").otherwise("W"))


def byte(x: Column) -> Column:
    """Unsigned 8-bit value, as SMALLINT."""
    return F.pmod(x.cast("int"), F.lit(256)).cast("smallint")


def above(x: Column, threshold: float) -> Column:
    return (x > threshold).cast("int")


def manmade(x: Column) -> Column:
    """Nonzero years are shifted by 100."""
    return F.when(x > 0, byte(x + 100)).otherwise(F.lit(0).cast("smallint"))


def rewrite_key(path: Column, old: str, new: str) -> Column:
    """What is before the first old, and new."""
    return F.concat(F.split_part(path, F.lit(old), F.lit(1)), F.lit(new))


def before(name: Column, mark: str) -> Column:
    return F.split_part(name, F.lit(mark), F.lit(1))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * EARTH_RADIUS


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.pi() / 4 + F.radians(lat) / 2)) * EARTH_RADIUS


def lon_of_mercator(x: Column) -> Column:
    return F.degrees(x / EARTH_RADIUS)


def lat_of_mercator(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / EARTH_RADIUS)) - F.pi() / 2)


def disjoint(a: dict, b: dict) -> Column:
    """Boxes (xmin, xmax, ymin, ymax columns) that don't even touch."""
    return (a["xmax"] < b["xmin"]) | (a["xmin"] > b["xmax"]) | (a["ymax"] < b["ymin"]) | (a["ymin"] > b["ymax"])


def read_window(box: dict, x0, dx, y0, dy, cols, rows) -> dict:
    """Offsets and sizes of the pixels read for a box (xmin, xmax, ymin, ymax) that meets a raster; dy is negative.

    The box is cut to the raster first. The size is rounded up from the cut box, not from its floored offset, so the
    last column or row that the box touches may be missed; at least one pixel is read.
    """
    left, right = F.greatest(box["xmin"], F.lit(float(x0))), F.least(box["xmax"], F.lit(float(x0 + dx * cols)))
    low, high = F.greatest(box["ymin"], F.lit(float(y0 + dy * rows))), F.least(box["ymax"], F.lit(float(y0)))
    col = F.least(F.floor((left - x0) / dx).cast("int"), F.lit(cols - 1))
    row = F.least(F.floor((high - y0) / dy).cast("int"), F.lit(rows - 1))
    return {
        "col_off": col, "row_off": row,
        "win_cols": F.least(F.greatest(F.ceil((right - left) / dx).cast("int"), F.lit(1)), F.lit(cols) - col),
        "win_rows": F.least(F.greatest(F.ceil((high - low) / abs(dy)).cast("int"), F.lit(1)), F.lit(rows) - row),
    }


def slope_name(name: Column) -> Column:
    return F.concat(name, F.lit("_slope"))


def smoothed_name(name: Column) -> Column:
    return F.concat(name, F.lit("_smoothed"))


def change_name(tile: Column) -> Column:
    return F.concat(tile, F.lit("_change"))


def training_name(feature: Column, tile: Column) -> Column:
    return F.concat_ws("_", feature, tile, F.lit("training"))


def polygons_name(block: Column) -> Column:
    return F.concat(block.cast("string"), F.lit("_polygons"))


def cropped_name(base: Column, feature: Column, merged: Column) -> Column:
    """Name of a crop of one raster, or of several that were merged on the way."""
    return F.concat_ws("_", base, feature, F.lit("cropped"), F.when(merged, "merged"))


def date_stamp(day: Column) -> Column:
    """As jan05_2024."""
    return F.lower(F.date_format(day, "MMMdd_yyyy"))


def block_origin(brow: Column, bcol: Column, x0: float, dx: float, y0: float, dy: float) -> tuple[Column, Column]:
    """World coordinates of a block's upper left corner."""
    return x0 + bcol * dx, y0 + brow * dy


def to_world(rings: Column, x0: float, dx: float, y0: float, dy: float) -> Column:
    """Rings in pixel space as rings in world coordinates."""
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct((x0 + p["x"] * dx).alias("x"), (y0 + p["y"] * dy).alias("y"))))


def to_pixels(rings: Column, x0: float, dx: float, y0: float, dy: float) -> Column:
    """Rings in world coordinates as rings in pixel space, rows downwards."""
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(((p["x"] - x0) / dx).alias("x"), ((p["y"] - y0) / dy).alias("y"))))


def reproject(rings: Column, srid: Column, target: int) -> Column:
    """Rings in the target system, 4326 or 3857; rings that are there already stay, other systems are an error."""
    if target not in (4326, 3857):
        raise ValueError(f"cannot convert to EPSG:{target}")
    to = (mercator_x, mercator_y) if target == 3857 else (lon_of_mercator, lat_of_mercator)
    other = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(to[0](p["x"]).alias("x"), to[1](p["y"]).alias("y"))))
    known = F.when(srid == target, rings).when(srid == (4326 if target == 3857 else 3857), other)
    return F.coalesce(known, F.raise_error(F.concat(F.lit("cannot convert EPSG:"), F.coalesce(srid.cast("string"), F.lit("null")))).cast("array<array<struct<x:double,y:double>>>"))
