"""Pixels on their way to blocks."""

import re

import pytest

from geoloom.operators import grid

SCHEMA = "prow int, pcol int, value int"


def test_a_cell_and_its_value_are_dealt(spark):
    plan = grid.scatter(spark.range(9).selectExpr("int(id) AS prow", "int(id) AS pcol", "1 AS value"), 9, 9, 4)._jdf.queryExecution().executedPlan().toString()
    assert len(re.search(r"Project \[(.*)\]", plan)[1].split(" AS ")) <= 4, plan


def test_rows_of_uneven_blocks(spark):
    pixels = {(r, c): (r * 7 + c) % 250 for r in range(5) for c in range(11) if (r + c) % 3}
    df = spark.createDataFrame([(*k, v) for k, v in pixels.items()], SCHEMA)
    blocks = grid.scatter(df, 11, 5, 4)
    assert {(r.block_row, r.block_col): (r.height, r.width) for r in blocks.collect()} == {(b, a): (min(4, 5 - b * 4), min(4, 11 - a * 4)) for b in range(2) for a in range(3)}
    assert {(r.prow, r.pcol): r.value for r in grid.gather(blocks, 4).collect()} == pixels


@pytest.mark.parametrize("at", [(-1, 0), (0, -1), (5, 0), (0, 11)])
def test_outside_is_an_error(spark, at):
    with pytest.raises(Exception, match="outside the raster"):
        grid.scatter(spark.createDataFrame([(*at, 1)], SCHEMA), 11, 5, 4).collect()
