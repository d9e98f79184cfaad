"""Tiles are few, but the cells that they cover grow with the raster: they are never broadcast."""

import pytest
from test_broadcasts import DATA, broadcasts

from geoloom import catalogue


@pytest.mark.parametrize("name", ["tile_list", "zone_tiles", "bbox_join", "tile_semi_join"])
def test_no_broadcast_of_cells(spark, name):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        plan = catalogue.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    for tree in broadcasts(plan):
        tree = tree.split("HashAggregate(keys=[location#")[0]  # one row a tile
        assert "Generate explode(sequence(" not in tree, tree[:600]
