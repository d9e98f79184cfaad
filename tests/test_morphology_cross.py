"""Thinning, gap closing and polygons of the registered queries against plain Python on every block with its halo."""

import math

import numpy as np
import pytest
from support import DATA

from geoloom import catalogue
from geoloom.operators import grid, morphology
from geoloom.sources import rasters

AROUND = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def thinned(cells):
    """Zhang and Suen on a set of cells."""
    cells = set(cells)
    while True:
        gone = 0
        for first in (True, False):
            drop = []
            for r, c in cells:
                p = [(r + a, c + b) in cells for a, b in AROUND]
                turns = sum(not x and y for x, y in zip(p, p[1:] + p[:1]))
                north, east, south, west = p[0], p[2], p[4], p[6]
                held = (north and east and south) or (east and south and west) if first else (north and east and west) or (north and south and west)
                if 2 <= sum(p) <= 6 and turns == 1 and not held:
                    drop.append((r, c))
            cells -= set(drop)
            gone += len(drop)
        if not gone:
            return cells


def closed(cells, gap):
    out = thinned(cells)
    ends = sorted(x for x in out if sum((x[0] + a, x[1] + b) in out for a, b in AROUND) == 1)
    linked, extra = set(), set()
    for i, (r, c) in enumerate(ends):
        if i not in linked:
            best = min(((math.dist((r, c), ends[j]), j) for j in range(len(ends)) if j != i and j not in linked), default=None)
            if best and best[0] <= gap:
                linked |= {i, best[1]}
                extra |= set(morphology.line_cells(r, c, *ends[best[1]]))
    return out | extra


def pieces(cells):
    cells, out = set(cells), []
    while cells:
        todo = [cells.pop()]
        found = set(todo)
        while todo:
            r, c = todo.pop()
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in cells:
                    cells.remove(n)
                    found.add(n)
                    todo.append(n)
        out.append(found)
    return out


@pytest.fixture(scope="module")
def blocks(spark):
    size = rasters.linear_size(spark, DATA)
    lines = {(r.prow, r.pcol) for r in rasters.linear_raster(spark, DATA, size).where("value > 30").collect()}
    out = []
    for r in grid.block_grid(spark, size, size, 48, 24).collect():
        assert r.asDict() == grid.place_of(r.block_id, size, size, 48, 24)
        within = {(y, x) for y, x in lines if r.hrow <= y < r.hrow + r.hheight and r.hcol <= x < r.hcol + r.hwidth}
        out.append((r, within, lambda y, x, r=r: r.brow <= y < r.brow + r.height and r.bcol <= x < r.bcol + r.width))
    return out


def test_skeleton(spark, blocks):
    got = {tuple(r) for r in catalogue.skeleton(spark, DATA).collect()}
    assert got == {(r.block_id, *x) for r, within, own in blocks for x in thinned(within) if own(*x)}


def test_close_gaps(spark, blocks):
    got = {tuple(r) for r in catalogue.close_gaps(spark, DATA).collect()}
    assert got == {(r.block_id, *x) for r, within, own in blocks for x in closed(within, 8) if own(*x)}


def test_polygons(spark, blocks):
    want = []
    for r, within, own in blocks:
        lines = closed(within, 4)
        free = {(y, x) for y in range(r.hrow, r.hrow + r.hheight) for x in range(r.hcol, r.hcol + r.hwidth)} - lines
        on_edge = lambda y, x: y in (r.hrow, r.hrow + r.hheight - 1) or x in (r.hcol, r.hcol + r.hwidth - 1)  # noqa: B023, E731
        inside = {x for p in pieces(free) if len(p) >= 2 and not any(on_edge(*x) for x in p) for x in p if own(*x)}
        for p in pieces(inside):
            edges = sum((y + a, x + b) not in p for y, x in p for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0)))
            want.append((r.block_id, min(p), len(p), float(len(p)), float(edges)))
    size = rasters.linear_size(spark, DATA)
    found = morphology.extract_polygons(rasters.linear_raster(spark, DATA, size).where("value > 30"), size, size, 48, 24, 4, 2).collect()
    got = []
    for r in found:
        corners = [[(p.x, p.y) for p in ring] for ring in r.rings]
        assert all(ring[0] == ring[-1] for ring in corners)
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for ring in corners for a, b in zip(ring, ring[1:]))) / 2
        way = sum(abs(a[0] - b[0]) + abs(a[1] - b[1]) for ring in corners for a, b in zip(ring, ring[1:]))
        top = min(y for ring in corners for _, y in ring)
        got.append((r.block_id, (int(top), int(min(x for ring in corners for x, y in ring if y == top))), r.area, area, way))
    assert want and sorted(got) == sorted(want)
    registered = [tuple(r) for r in catalogue.extract_polygons(spark, DATA).select("block_id", "polygon", "area").collect()]
    assert sorted(registered) == sorted((r.block_id, r.polygon, r.area) for r in found)


def test_lines():
    for r, c in [(0, 0), (0, 7), (5, 0), (3, 9), (-6, 4), (8, -8), (-2, -11)]:
        cells = morphology.line_cells(1, 2, 1 + r, 2 + c)
        assert cells[0] == (1, 2) and cells[-1] == (1 + r, 2 + c) and len(cells) == max(abs(r), abs(c)) + 1
        assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(cells, cells[1:]))
        away = [abs(c * (y - 1) - r * (x - 2)) / max(abs(r), abs(c), 1) for y, x in cells]
        assert max(away) <= 0.5 + 1e-9


def test_labels_of_large_masks():
    rng = np.random.default_rng(5)
    for share in (0.0, 0.3, 0.6, 1.0):
        m = rng.random((70, 90)) < share
        got = morphology.label(m)
        parts = sorted(pieces(zip(*(x.tolist() for x in np.nonzero(m)))), key=min)
        assert got.max(initial=0) == len(parts) and all({int(got[x]) for x in p} == {k} for k, p in enumerate(parts, 1))


def test_semi_join_keeps_equal_rows(spark):
    box = "xmin double, xmax double, ymin double, ymax double"
    left = spark.createDataFrame([("a", 0.0, 90.0, 0.0, 90.0)] * 3 + [("b", 200.0, 201.0, 0.0, 1.0)], "n string, " + ", ".join(f"l_{c}" for c in box.split(", ")))
    right = spark.createDataFrame([(10.0, 80.0, 10.0, 80.0), (5.0, 6.0, 5.0, 6.0)], ", ".join(f"r_{c}" for c in box.split(", ")))
    assert [r.n for r in grid.cell_join(left, right, 16.0, "left_semi").collect()] == ["a"] * 3
