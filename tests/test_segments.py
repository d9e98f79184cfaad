"""The change raster as segments: the same pixels, dealt out once."""

import pytest

from geoloom import catalogue
from geoloom.operators import zonal
from geoloom.sources import rasters

DATA = "/root/testdata/sf0.001"


def test_segments_are_the_raster(spark):
    size = rasters.side(spark, DATA)
    want = {(r.prow, r.pcol): r.value for r in rasters.change_raster(spark, DATA, size).collect()}
    got = {(r.prow, r.segment * zonal.SEGMENT + i): v for r in rasters.change_segments(spark, DATA, size).collect() for i, v in enumerate(r.cells)}
    assert got == want


@pytest.mark.parametrize("truncate", [False, True])
def test_zones_meet_segments_as_pixels(spark, truncate):
    size = rasters.side(spark, DATA)
    zones = rasters.zones(spark, DATA, size)
    rows = lambda pixels: sorted(map(str, zonal.zone_pixels(zones, pixels, size, size, truncate).collect()))
    assert rows(rasters.change_segments(spark, DATA, size)) == rows(rasters.change_raster(spark, DATA, size))


def shuffles(plan: str) -> int:
    """Exchanges between the lines and their join with spans."""
    lines = plan.splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    i = next(k for k, x in enumerate(lines) if "Scan parquet" in x and "lineitem.parquet" in x)
    n, at = 0, depth[i]
    while "SortMergeJoin" not in lines[i]:
        i -= 1
        if depth[i] < at:
            at, n = depth[i], n + lines[i].lstrip(" :+-").startswith("Exchange")
    return n


@pytest.mark.parametrize("name", ["tile_nonblank", "extract_v2_pixels", "extract_v1_manmade", "zonal_mode", "status_of_inputs"])
def test_lines_are_dealt_once(spark, name):
    assert shuffles(catalogue.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()) == 1
