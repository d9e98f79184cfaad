import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import expressions as E
from geoloom.operators import focal, grid, morphology, vector, zonal
from geoloom.sources import listing, rasters


def test_change_class(spark):
    nan = float("nan")
    cases = [(None, None, "null_both"), (nan, nan, "null_both"), (100.0, 100.0, "extract_all"), (5.0, 9.0, "natural"), (105.0, 109.0, "manmade"), (100.0, 105.0, "skip"), (50.0, 150.0, "skip"), (150.0, nan, "skip"), (5.0, None, "skip")]
    rows = spark.createDataFrame(cases, "a double, b double, want string").select(E.change_class(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows)


def test_listing(spark, tmp_path):
    (tmp_path / "l.csv").write_text('id,name\n1,a_CHM\n\n  2,b"x_CHM,zz  \n3, c_CHM\n')
    got = listing.read_listing(spark, str(tmp_path / "l.csv"))
    assert {r.path for r in got.collect()} == {"a_CHM.tif", 'b"x_CHM.tif', " c_CHM.tif"}


def test_value_rules(spark):
    values = [0, 0, 5, 7, 7, 5, 9]
    zone = lambda a, b: spark.createDataFrame([(1, 1, 0, i, v, a, b) for i, v in enumerate(values)], "zone_id long, ord long, prow int, pcol int, value int, year_start double, year_end double")
    run = lambda d: [r.value for r in d.orderBy("pcol").collect()]
    assert run(zonal.extract_v2(zone(None, None))) == [0, 0, 5, 5]
    assert run(zonal.extract_v2(zone(5.0, 7.0))) == [0, 0, 5, 7, 7, 5]
    assert run(zonal.extract_v2(zone(100.0, 100.0))) == [0, 0, 105, 107, 107, 105, 109]
    assert run(zonal.extract_v2(zone(106.0, 110.0))) == [0, 0, 107, 107, 109]
    assert run(zonal.extract_v1(zone(None, None), "natural")) == [0, 0, 5, 0, 0, 5, 0]
    assert run(zonal.extract_v1(zone(None, None), "manmade")) == values
    assert run(zonal.extract_v1(zone(6.0, 10.0), "manmade")) == [0, 0, 0, 7, 7, 0, 9]
    with pytest.raises(ValueError):
        zonal.extract_v1(zone(None, None), "other")


def test_block_grid(spark):
    rows = {r.block_id: r for r in grid.block_grid(spark, 5000, 3000, 2048, 1024).collect()}
    assert tuple(rows[2])[3:] == (904, 2048, 3072, 0, 1928, 3000, 1024, 0)
    assert tuple(rows[4])[3:] == (2048, 952, 1024, 1024, 3976, 1976, 1024, 1024)
    with pytest.raises(ValueError):
        grid.check_block(6, 5000, 3000, 2048)


def test_scatter(spark):
    p = spark.createDataFrame([(550, 515, 7)], "prow int, pcol int, value int")
    (b,) = grid.scatter(p, 520, 600, 512).collect()
    cells = np.frombuffer(b.cells, np.uint8).reshape(b.height, b.width)
    assert (b.block_row, b.block_col, b.height, b.width, cells[38, 3], (cells == 255).sum()) == (1, 1, 88, 8, 7, 88 * 8 - 1)


def test_dilate_overwrites_nodata(spark):
    p = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, -9999.0)], "prow int, pcol int, value double")
    assert {r.value for r in focal.dilate(p).collect()} == {3.0}
    assert sorted(r.value for r in focal.dilate(p, mask_nodata=-9999.0).collect()) == [-9999.0, 3.0, 3.0, 3.0]


def test_slope_of_plane_and_nodata(spark):
    p = spark.createDataFrame([(r, c, float(3 * c)) if (r, c) != (2, 2) else (2, 2, -9999.0) for r in range(5) for c in range(5)], "prow int, pcol int, value double")
    got = {(r.prow, r.pcol): r.value for r in focal.slope(p).collect()}
    assert got[2, 2] == -9999.0 and math.isclose(got[0, 0], math.degrees(math.atan(3)), rel_tol=1e-9) and math.isclose(got[4, 4], math.degrees(math.atan(3)), rel_tol=1e-9)


def test_scanline_on_centre_ties(spark):
    f = spark.range(1).select(F.col("id").alias("zone_id"), rasters.box_rings(F.lit(3.5), F.lit(3.5), F.lit(9.5), F.lit(8.5)).alias("rings"))
    got = {(r.prow, r.pcol) for r in vector.rasterize(f).collect()}
    assert got == {(r, c) for r in range(3, 8) for c in range(4, 10)}


def test_interior_and_area():
    ring = np.zeros((5, 5), bool)
    ring[1:4, 1:4] = True
    ring[2, 2] = False
    diamond = np.zeros((5, 5), bool)
    for r, c in ((1, 2), (2, 1), (2, 3), (3, 2)):
        diamond[r, c] = True
    for m in (ring, diamond):
        assert np.argwhere(morphology.interior(m, 1)).tolist() == [[2, 2]] and not morphology.interior(m, 2).any()


def test_gap_between_segments_stays_open():
    m = np.zeros((3, 14), bool)
    m[1, 0:5] = m[1, 7:12] = True
    assert (morphology.close_gaps(m, 80) == m).all()


def test_thin_keeps_lines_and_trace_closes():
    thick = np.zeros((9, 20), bool)
    thick[3:6, 2:18] = True
    s = morphology.thin(thick)
    assert s.any() and s.sum() < 20 and (s & ~thick).sum() == 0
    square = np.zeros((6, 6), bool)
    square[1:5, 1:5] = True
    square[2, 2] = False
    rings = morphology.trace(square)
    assert len(rings) == 2 and all(r[0] == r[-1] for r in rings)
    area = sum(a[0] * b[1] - b[0] * a[1] for r in rings for a, b in zip(r, r[1:])) / 2
    assert abs(area) == square.sum()


def test_label_against_flood():
    rng = np.random.default_rng(3)
    m = rng.random((20, 20)) < 0.55
    got = morphology.label(m)
    seen = np.zeros_like(got)
    k = 0
    for r in range(20):
        for c in range(20):
            if m[r, c] and not seen[r, c]:
                k += 1
                todo = [(r, c)]
                while todo:
                    y, x = todo.pop()
                    if 0 <= y < 20 and 0 <= x < 20 and m[y, x] and not seen[y, x]:
                        seen[y, x] = k
                        todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    assert (got == seen).all()


def test_mercator_round_trip(spark):
    p = spark.createDataFrame([(-60.5, 11.25)], "lon double, lat double")
    r = p.select(E.lon_of_mercator(E.mercator_x(F.col("lon"))).alias("a"), E.lat_of_mercator(E.mercator_y(F.col("lat"))).alias("b")).first()
    assert math.isclose(r.a, -60.5) and math.isclose(r.b, 11.25)
