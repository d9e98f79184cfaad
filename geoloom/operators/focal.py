"""3 x 3 neighbourhoods by value-based window frames.

Pixels are dealt once, by blocks with a border of one pixel, which alone is copied; all windows lie within a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 128
_HOME = ("block_row", "block_col")


def _blocks(pixels: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Pixels by block and border, in one shuffle; `home` where a pixel is the block's own."""
    of = lambda c, step: F.floor((F.col(c) + step) / block).cast("int")
    near = lambda c: F.explode(F.array_distinct(F.array(of(c, -1), of(c, 1))))
    spread = pixels.withColumn("block_row", near("prow")).withColumn("block_col", near("pcol"))
    return spread.withColumn("home", (of("prow", 0) == F.col("block_row")) & (of("pcol", 0) == F.col("block_col"))).repartition(*keys, *_HOME)


def _own(blocks: DataFrame) -> DataFrame:
    return blocks.where("home").drop("home", *_HOME)


def _separable(pixels: DataFrame, function, keys: list[str]) -> DataFrame:
    across = Window.partitionBy(*keys, *_HOME, "prow").orderBy("pcol").rangeBetween(-1, 1)
    down = Window.partitionBy(*keys, *_HOME, "pcol").orderBy("prow").rangeBetween(-1, 1)
    return _own(_blocks(pixels, keys).withColumn("value", function("value").over(across)).withColumn("value", function("value").over(down)))


def dilate(pixels: DataFrame, keys: list[str] = (), mask_nodata: float | None = None) -> DataFrame:
    """Largest of 3 x 3; nodata counts as a number unless masked."""
    if mask_nodata is None:
        return _separable(pixels, F.max, list(keys))
    wide = _separable(pixels.withColumn("was", F.col("value")), F.max, list(keys))
    return wide.withColumn("value", F.when(F.col("was") == mask_nodata, mask_nodata).otherwise(F.col("value"))).drop("was")


def sum3(pixels: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Sum of 3 x 3; missing neighbours are 0."""
    return _separable(pixels, F.sum, list(keys))


def slope(pixels: DataFrame, dx: float = 1.0, dy: float = 1.0, nodata: float = -9999.0, keys: list[str] = ()) -> DataFrame:
    """Slope in degrees (Horn, 1981). Beyond edges values go on linearly; a nodata neighbour counts as the centre."""
    across, down = Window.partitionBy(*keys, *_HOME, "prow").orderBy("pcol"), Window.partitionBy(*keys, *_HOME, "pcol").orderBy("prow")
    beside = lambda c, k, w, at: F.when(F.lag(at, -k).over(w) == F.col(at) + k, F.lag(c, -k).over(w))
    flat = _blocks(pixels, list(keys)).withColumns({"w": beside("value", -1, across, "pcol"), "e": beside("value", 1, across, "pcol")})
    rows = {n: {c: beside(c, k, down, "prow") for c in ("w", "value", "e")} for n, k in (("n", -1), ("s", 1))}
    all_ = _own(flat.withColumns({f"{n}{c}": x for n, r in rows.items() for c, x in r.items()}))
    centre = F.col("value")
    get = lambda c: F.when(F.col(c) == nodata, centre).otherwise(F.col(c))
    n, m, s = ([get(p + c) for c in ("w", "value", "e")] for p in ("n", "", "s"))
    n, s = [F.coalesce(a, 2 * b - c, b) for a, b, c in zip(n, m, s, strict=True)], [F.coalesce(a, 2 * b - c, b) for a, b, c in zip(s, m, n, strict=True)]
    full = [(F.coalesce(w, 2 * v - e, v), v, F.coalesce(e, 2 * v - w, v)) for w, v, e in (n, m, s)]
    (w0, w1, w2), (w3, _, w5), (w6, w7, w8) = full
    dzdx, dzdy = ((w0 + 2 * w3 + w6) - (w2 + 2 * w5 + w8)) / dx, ((w6 + 2 * w7 + w8) - (w0 + 2 * w1 + w2)) / abs(dy)
    out = F.when(centre == nodata, nodata).otherwise(F.degrees(F.atan(F.sqrt(dzdx * dzdx + dzdy * dzdy) / 8)))
    return all_.select(*keys, "prow", "pcol", out.alias("value"))


def endpoints(skeleton: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Set pixels with one set neighbour; skeleton: full or sparse pixels of 0 and 1."""
    on = skeleton.where("value = 1")
    steps = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    spread = on.select(*keys, (F.col("prow")).alias("r"), F.col("pcol").alias("c"), F.explode(F.array(*steps)).alias("d")).select(*keys, (F.col("r") + F.col("d.a")).alias("prow"), (F.col("c") + F.col("d.b")).alias("pcol"))
    near = spread.groupBy(*keys, "prow", "pcol").agg(F.count(F.lit(1)).alias("near"))
    return on.join(near, [*keys, "prow", "pcol"]).where("near = 2").select(*keys, "prow", "pcol")


