"""Blocks with halos, cell keys and block scatter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import disjoint


def block_grid(spark: SparkSession, cols: int, rows: int, block: int, halo: int) -> DataFrame:
    """One row a block: its place and size, with halo, and the true block's place within the halo."""
    across, down = -(-cols // block), -(-rows // block)
    at = spark.range(across * down).select(F.col("id").cast("int").alias("block_id"), ((F.col("id") % across) * block).cast("int").alias("bcol"), (F.expr(f"id div {across}") * block).cast("int").alias("brow"))
    low = lambda c: F.greatest(F.col(c) - halo, F.lit(0))
    sized = at.withColumns({"width": F.least(F.lit(block), cols - F.col("bcol")), "height": F.least(F.lit(block), rows - F.col("brow")), "hcol": low("bcol"), "hrow": low("brow")})
    return sized.withColumns({
        "hwidth": F.least(F.col("bcol") + F.col("width") + halo, F.lit(cols)) - F.col("hcol"), "hheight": F.least(F.col("brow") + F.col("height") + halo, F.lit(rows)) - F.col("hrow"),
        "inner_col": F.col("bcol") - F.col("hcol"), "inner_row": F.col("brow") - F.col("hrow"),
    })


def place_of(block_id: int, cols: int, rows: int, block: int, halo: int) -> dict[str, int]:
    """What block_grid says of one block."""
    check_block(block_id, cols, rows, block)
    across = -(-cols // block)
    bcol, brow = block_id % across * block, block_id // across * block
    width, height, hcol, hrow = min(block, cols - bcol), min(block, rows - brow), max(bcol - halo, 0), max(brow - halo, 0)
    return {
        "block_id": block_id, "bcol": bcol, "brow": brow, "width": width, "height": height, "hcol": hcol, "hrow": hrow, "hwidth": min(bcol + width + halo, cols) - hcol,
        "hheight": min(brow + height + halo, rows) - hrow, "inner_col": bcol - hcol, "inner_row": brow - hrow,
    }


def check_block(block_id: int, cols: int, rows: int, block: int) -> None:
    n = -(-cols // block) * -(-rows // block)
    if not 0 <= block_id < n:
        raise ValueError(f"block {block_id} is outside 0..{n - 1}")


def replicate(pixels: DataFrame, cols: int, rows: int, block: int, halo: int) -> DataFrame:
    """Each pixel once for every block whose halo holds it."""
    across = -(-cols // block)
    span = lambda c, n: F.explode(F.sequence(F.greatest(F.expr(f"({c} - {halo}) div {block}"), F.lit(0)).cast("int"), F.least(F.expr(f"({c} + {halo}) div {block}"), F.lit(-(-n // block) - 1)).cast("int")))
    return pixels.withColumn("across", span("pcol", cols)).withColumn("down", span("prow", rows)).withColumn("block_id", F.col("down") * across + F.col("across")).drop("across", "down")


def cell_join(left: DataFrame, right: DataFrame, cell: float, how: str = "inner") -> DataFrame:
    """Rows whose envelopes (l_/r_ xmin, xmax, ymin, ymax) meet: an equi-join on grid cells, each pair once.

    A pair is kept in the cell that holds the lower corner of its overlap, so no distinct is needed. left_semi: each
    row of left once, as often as it stands there. Cells of a side grow with its extent, however few its rows are, so
    neither side is broadcast.
    """
    span = lambda s, a: F.explode(F.sequence(F.floor(F.col(f"{s}_{a}min") / cell), F.floor(F.col(f"{s}_{a}max") / cell)))
    cells = lambda d, s: d.withColumn("cx", span(s, "x")).withColumn("cy", span(s, "y"))
    corner = lambda a: F.floor(F.greatest(f"l_{a}min", f"r_{a}min") / cell)
    box = lambda s: {k: F.col(f"{s}_{k}") for k in ("xmin", "xmax", "ymin", "ymax")}
    meet = ~disjoint(box("l"), box("r")) & (corner("x") == F.col("cx")) & (corner("y") == F.col("cy"))
    if how == "left_semi":
        numbered = left.withColumn("l_row", F.monotonically_increasing_id())
        found = cells(numbered, "l").join(cells(right.select(*[c for c in right.columns if c.startswith("r_")]), "r").hint("merge"), ["cx", "cy"]).where(meet)
        return found.dropDuplicates(["l_row"]).select(*left.columns)
    return cells(left, "l").join(cells(right, "r").hint("merge"), ["cx", "cy"]).where(meet).drop("cx", "cy")


_WIDE = {"uint8": "int", "float32": "float"}


def scatter(pixels: DataFrame, cols: int, rows: int, block: int = 512, nodata: float = 255, dtype: str = "uint8") -> DataFrame:
    """Dense blocks of those blocks that have pixels; other cells are nodata. dtype: uint8, whose values wrap, or float32."""

    n, wide = block * block, -(-cols // block)

    def fill(key, rows_):
        import numpy as np
        import pandas as pd

        down, across = int(key[0]) // wide, int(key[0]) % wide
        height, width = min(block, rows - down * block), min(block, cols - across * block)
        cells = np.full((height, width), nodata, dtype)
        values = rows_["value"].astype(int) % 256 if dtype == "uint8" else rows_["value"].astype(dtype)
        at = rows_["cell"] % n
        cells[at // block, at % block] = values
        return pd.DataFrame([(down, across, height, width, cells.tobytes())], columns=["block_row", "block_col", "height", "width", "cells"])

    # Only a cell's number and value are dealt out, numbered block by block; the key is derived from it.
    inside = F.col("prow").between(0, rows - 1) & F.col("pcol").between(0, cols - 1)
    cell = F.expr(f"((prow div {block}) * {wide} + pcol div {block}) * {n}L + (prow % {block}) * {block} + pcol % {block}")
    placed = pixels.select(F.when(inside, cell).otherwise(F.raise_error(F.lit("a pixel is outside the raster")).cast("long")).alias("cell"), "value")
    return placed.groupBy(F.expr(f"cell div {n}L").alias("block_id")).applyInPandas(fill, "block_row int, block_col int, height int, width int, cells binary")


def gather(blocks: DataFrame, block: int = 512, nodata: float = 255, dtype: str = "uint8") -> DataFrame:
    """Pixels of dense blocks that aren't nodata."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for r in batch.itertuples():
                cells = np.frombuffer(r.cells, dtype).reshape(r.height, r.width)
                y, x = np.nonzero(cells != np.dtype(dtype).type(nodata))
                yield pd.DataFrame({"prow": (y + r.block_row * block).astype(np.int32), "pcol": (x + r.block_col * block).astype(np.int32), "value": cells[y, x].astype(np.int32 if dtype == "uint8" else np.float32)})

    return blocks.mapInPandas(run, f"prow int, pcol int, value {_WIDE[dtype]}")
