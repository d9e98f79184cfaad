"""Thinning, gap closing, components, enclosed areas and polygons of blocks: NumPy kernels behind applyInPandas.

A group is one block with its halo, whose size the caller fixes, so a task's memory is bounded.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise
from .graph import connected_components
from .grid import block_grid, place_of, replicate


def thin(mask: np.ndarray) -> np.ndarray:
    """One-pixel skeleton (Zhang and Suen, 1984)."""
    m = np.pad(mask.astype(bool), 1)
    while True:
        removed = False
        for first in (True, False):
            c = m[1:-1, 1:-1]
            ring = [m[:-2, 1:-1], m[:-2, 2:], m[1:-1, 2:], m[2:, 2:], m[2:, 1:-1], m[2:, :-2], m[1:-1, :-2], m[:-2, :-2]]
            count = sum(r.astype(int) for r in ring)
            turns = sum((~a & b).astype(int) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))
            north, east, south, west = ring[0], ring[2], ring[4], ring[6]
            blocked = (north & east & south) | (east & south & west) if first else (north & east & west) | (north & south & west)
            drop = c & (count >= 2) & (count <= 6) & (turns == 1) & ~blocked
            if drop.any():
                m[1:-1, 1:-1] = c & ~drop
                removed = True
        if not removed:
            return m[1:-1, 1:-1]


def line_cells(r0: int, c0: int, r1: int, c1: int) -> list[tuple[int, int]]:
    """Cells of a straight line with both ends (Bresenham)."""
    dr, dc, out, error = abs(r1 - r0), abs(c1 - c0), [], abs(c1 - c0) - abs(r1 - r0)
    while True:
        out.append((r0, c0))
        if (r0, c0) == (r1, c1):
            return out
        twice = 2 * error
        if twice > -dr:
            error, c0 = error - dr, c0 + (1 if c1 > c0 else -1)
        if twice < dc:
            error, r0 = error + dc, r0 + (1 if r1 > r0 else -1)


def end_cells(skeleton: np.ndarray) -> list[tuple[int, int]]:
    p = np.pad(skeleton.astype(int), 1)
    near = sum(p[i : i + skeleton.shape[0], j : j + skeleton.shape[1]] for i in range(3) for j in range(3))
    return list(zip(*(x.tolist() for x in np.where(skeleton.astype(bool) & (near == 2))), strict=True))


def close_gaps(mask: np.ndarray, gap: float) -> np.ndarray:
    """The skeleton, with each end in row-major order linked to its nearest unlinked end within gap (ties: the first)."""
    out = thin(mask)
    ends = end_cells(out)
    cells: dict[tuple[int, int], list[int]] = {}
    size = max(1, math.ceil(gap))
    for k, (r, c) in enumerate(ends):
        cells.setdefault((r // size, c // size), []).append(k)
    linked: set[int] = set()
    for i, (r, c) in enumerate(ends):
        if i in linked:
            continue
        near = [j for a in (-1, 0, 1) for b in (-1, 0, 1) for j in cells.get((r // size + a, c // size + b), ()) if j != i and j not in linked]
        best = min(((math.hypot(ends[j][0] - r, ends[j][1] - c), j) for j in near), default=None)
        if best and best[0] <= gap:
            linked.update((i, best[1]))
            for y, x in line_cells(r, c, *ends[best[1]]):
                out[y, x] = True
    return out


def label(mask: np.ndarray) -> np.ndarray:
    """4-connected components, numbered from 1 in row-major order of their first cells: runs of cells, joined downwards."""
    m = mask.astype(bool)
    begins = m & ~np.pad(m, ((0, 0), (1, 0)))[:, :-1]
    run = np.cumsum(begins).reshape(m.shape) - 1
    touch = m[:-1] & m[1:]
    edges = np.unique(np.stack([run[:-1][touch], run[1:][touch]]), axis=1)
    least = np.arange(int(begins.sum()))
    while True:
        a, b = least[edges[0]], least[edges[1]]
        apart = a != b
        if not apart.any():
            break
        np.minimum.at(least, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (least[least] != least).any():
            least = least[least]
    name = np.cumsum(least == np.arange(len(least)))  # a component's least run is its first in row-major order
    return np.where(m, name[least][run] if len(least) else 0, 0)


def interior(lines: np.ndarray, min_area: int) -> np.ndarray:
    """Background enclosed by lines: components that touch no edge and have min_area cells."""
    found = label(~lines.astype(bool))
    edge = np.unique(np.concatenate([found[0], found[-1], found[:, 0], found[:, -1]]))
    inside = np.where(np.isin(found, edge), 0, found)
    sizes = np.bincount(inside.ravel(), minlength=1)
    return (inside > 0) & ((sizes[inside] >= min_area) if min_area > 0 else True)


def trace(mask: np.ndarray) -> list[list[tuple[int, int]]]:
    """Closed rings (x, y) along pixel edges of a mask, holes among them; cells that touch at a corner stay apart."""
    p = np.pad(mask.astype(bool), 1)
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in zip(*np.nonzero(p), strict=True):
        y, x = int(r) - 1, int(c) - 1
        for free, a, b in ((not p[r - 1, c], (x, y), (x + 1, y)), (not p[r, c + 1], (x + 1, y), (x + 1, y + 1)), (not p[r + 1, c], (x + 1, y + 1), (x, y + 1)), (not p[r, c - 1], (x, y + 1), (x, y))):
            if free:
                after.setdefault(a, []).append(b)
    rings = []
    while after:
        start = min(after)
        ring, at, came = [start], start, (0, 0)
        while True:
            options = after[at]
            turn = lambda b: came[0] * (b[1] - at[1]) - came[1] * (b[0] - at[0])  # noqa: B023, E731
            to = max(options, key=turn)  # clockwise on screen: keep to the cell's own side
            options.remove(to)
            if not options:
                del after[at]
            came, at = (to[0] - at[0], to[1] - at[1]), to
            ring.append(at)
            if at == start:
                break
        rings.append([ring[0], *(b for a, b, c in zip(ring, ring[1:], ring[2:], strict=False) if (b[0] - a[0]) * (c[1] - b[1]) != (b[1] - a[1]) * (c[0] - b[0])), ring[-1]])
    return rings


def _grid_of(rows, height: int, width: int, top: int = 0, left: int = 0) -> np.ndarray:
    out = np.zeros((height, width), bool)
    out[rows["prow"].to_numpy() - top, rows["pcol"].to_numpy() - left] = True
    return out


def per_block(lines: DataFrame, cols: int, rows: int, block: int, halo: int, kernel, schema: str) -> DataFrame:
    """kernel(mask, place) -> pandas rows for each block with halo; lines: set pixels (prow, pcol)."""

    def run(key, pixels):
        at = place_of(int(key[0]), cols, rows, block, halo)
        return kernel(_grid_of(pixels, at["hheight"], at["hwidth"], at["hrow"], at["hcol"]), at)

    return replicate(lines.select("prow", "pcol"), cols, rows, block, halo).groupBy("block_id").applyInPandas(run, schema)


def _cells_of(mask: np.ndarray, at: dict):
    """Absolute cells of the true block."""
    import pandas as pd

    y, x = np.nonzero(mask[at["inner_row"] : at["inner_row"] + at["height"], at["inner_col"] : at["inner_col"] + at["width"]])
    return pd.DataFrame({"block_id": np.full(len(y), at["block_id"], np.int32), "prow": (y + at["brow"]).astype(np.int32), "pcol": (x + at["bcol"]).astype(np.int32)})


CELLS = "block_id int, prow int, pcol int"


def skeleton(lines: DataFrame, cols: int, rows: int, block: int, halo: int) -> DataFrame:
    return per_block(lines, cols, rows, block, halo, lambda m, at: _cells_of(thin(m), at), CELLS)


def closed(lines: DataFrame, cols: int, rows: int, block: int, halo: int, gap: float) -> DataFrame:
    return per_block(lines, cols, rows, block, halo, lambda m, at: _cells_of(close_gaps(m, gap), at), CELLS)


def _labelled(set_cells: DataFrame, cols: int, rows: int, block: int, invert: bool) -> DataFrame:
    """block_id, prow, pcol, local: 4-connected components (smallest prow * cols + pcol) within each block, of set cells or of those not set."""
    spark = set_cells.sparkSession
    inside = set_cells.select("prow", "pcol").where(F.col("prow").between(0, rows - 1) & F.col("pcol").between(0, cols - 1))
    at_block = replicate(inside, cols, rows, block, 0)
    if invert:  # blocks without set cells count as well
        at_block = at_block.unionByName(block_grid(spark, cols, rows, block, 0).select(F.lit(None).cast("int").alias("prow"), F.lit(None).cast("int").alias("pcol"), "block_id"))

    def run(key, pixels):
        import pandas as pd

        at = place_of(int(key[0]), cols, rows, block, 0)
        pixels = pixels[pixels["prow"].notna()].astype("int64")
        mask = _grid_of(pixels, at["height"], at["width"], at["brow"], at["bcol"])
        found = label(~mask if invert else mask)
        y, x = np.nonzero(found)
        _, first = np.unique(found[y, x], return_index=True)  # np.nonzero is in row-major order
        cell = (y + at["brow"]).astype(np.int64) * cols + x + at["bcol"]
        return pd.DataFrame({"block_id": np.full(len(y), at["block_id"], np.int32), "prow": (y + at["brow"]).astype(np.int32), "pcol": (x + at["bcol"]).astype(np.int32), "local": cell[first][found[y, x] - 1] if len(y) else cell})

    return at_block.groupBy("block_id").applyInPandas(run, CELLS + ", local long")


def _merged(set_cells: DataFrame, cols: int, rows: int, block: int, invert: bool = False) -> DataFrame:
    """block_id, prow, pcol, component of all blocks: components that meet at block edges are one."""
    cells = materialise(_labelled(set_cells, cols, rows, block, invert), "labels")
    near = lambda c: F.col(c) % block == 0
    edges = None
    for along, across in (("prow", "pcol"), ("pcol", "prow")):
        low = cells.where(near(along) & (F.col(along) > 0)).select((F.col(along) - 1).alias(along), across, F.col("local").alias("u"))
        high = cells.where(F.col(along) % block == block - 1).select(along, across, F.col("local").alias("v"))
        pairs = low.join(high, [along, across]).select("u", "v")
        edges = pairs if edges is None else edges.unionByName(pairs)
    names = connected_components(edges.distinct())
    return cells.join(names, cells["local"] == names["node"], "left").select("block_id", "prow", "pcol", F.coalesce("component", "local").alias("component"))


def enclosed(lines: DataFrame, cols: int, rows: int, block: int, min_area: int = 0) -> DataFrame:
    """Cells enclosed by lines as they are, over the whole raster: areas may cross blocks, and none touches the raster's edge."""
    cells = _merged(lines, cols, rows, block, invert=True)
    edge = F.col("prow").isin(0, rows - 1) | F.col("pcol").isin(0, cols - 1)
    inside = cells.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.max(edge).alias("open")).where(~F.col("open") & (F.col("n") >= min_area)).select("component")
    return cells.join(inside, "component", "left_semi").select("block_id", "prow", "pcol")


def extract_polygons(lines: DataFrame, cols: int, rows: int, block: int = 2048, halo: int = 1024, gap: float = 80, min_area: int = 80) -> DataFrame:
    """block_id, polygon and its ring (pixel space) of areas that lines enclose once gaps are closed; cut at block edges."""

    def kernel(mask, at):
        import pandas as pd

        inside = interior(close_gaps(mask, gap), min_area)[at["inner_row"] : at["inner_row"] + at["height"], at["inner_col"] : at["inner_col"] + at["width"]]
        found, out = label(inside), []
        y, x = np.nonzero(found)
        order = np.argsort(found[y, x], kind="stable")
        y, x = y[order], x[order]
        sizes = np.bincount(found.ravel())[1:]
        for k, (first, n) in enumerate(zip(np.cumsum(sizes) - sizes, sizes, strict=True), 1):  # each within its own box
            r, c = y[first : first + n], x[first : first + n]
            part = np.zeros((r.max() - r.min() + 1, c.max() - c.min() + 1), bool)
            part[r - r.min(), c - c.min()] = True
            left, top = int(c.min()) + at["bcol"], int(r.min()) + at["brow"]
            out.append((at["block_id"], k, int(n), [[{"x": float(px + left), "y": float(py + top)} for px, py in ring] for ring in trace(part)]))
        return pd.DataFrame(out, columns=["block_id", "polygon", "area", "rings"])

    return per_block(lines, cols, rows, block, halo, kernel, "block_id int, polygon int, area int, rings array<array<struct<x double, y double>>>")


def components(cells: DataFrame, height: int, width: int, block: int = 1024) -> DataFrame:
    """prow, pcol and component (smallest row * width + col) of 4-connected set cells of a raster, labelled by blocks."""
    return _merged(cells, width, height, block).select("prow", "pcol", "component")
