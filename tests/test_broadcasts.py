"""Rows that grow with customers or lines are never broadcast, however small Spark guesses exploded rows to be."""

import pytest

from geoloom import catalogue

DATA = "/root/testdata/sf0.001"
QUERIES = """
zone_tiles
tile_list
raster_tiles
training_tiles
footprint_rings
block_scatter
extract_v1_manmade
extract_v2_pixels
tile_nonblank
block_scatter_counts
extract_v2_status
extract_v1_natural
overlay_last_wins
status_of_inputs
footprint_mercator
zonal_pixels
zonal_mode
zonal_window_pixels
""".split()


def broadcasts(plan: str) -> list[str]:
    """The subtrees of all broadcasts of a plan."""
    lines = plan.splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    out = []
    for i, x in enumerate(lines):
        if x.lstrip(" :+-").startswith("BroadcastExchange"):
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out.append("\n".join(lines[i:end]))
    return out


@pytest.mark.parametrize("name", QUERIES)
def test_no_growing_broadcast(spark, name):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        plan = catalogue.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    for tree in broadcasts(plan):
        tree = tree.split("HashAggregate(keys=[location#")[0]  # one row a tile: as few as there are tiles
        assert "customer.parquet" not in tree and "lineitem.parquet" not in tree, tree[:600]
