"""Rings of many keys and blocks, traced together, against the kernel that traces one mask."""

import numpy as np
from pyspark.sql import functions as F

from geoloom.operators import morphology, vector


def test_groups_equal_single_masks(spark):
    rng, rows, cols, block, want, cells = np.random.default_rng(5), 17, 23, 8, {}, []
    for key in (None, *range(40)):
        mask = rng.random((rows, cols)) < rng.choice([0.02, 0.3, 0.6, 1.0])  # cells that touch at corners, holes, full blocks
        cells += [(key, int(r), int(c), 1) for r, c in np.argwhere(mask)]
        for k in range(9):
            r, c = k // 3 * block, k % 3 * block
            if mask[r : r + block, c : c + block].any():
                want[key, k] = [[(x + c, y + r) for x, y in ring] for ring in morphology.trace(mask[r : r + block, c : c + block])]
    pixels = spark.createDataFrame(cells, "k string, prow int, pcol int, value int").unionByName(spark.createDataFrame([("0", 0, 0, 255)], "k string, prow int, pcol int, value int"))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for batch in ("7", was):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)  # groups over many batches, and many groups in one
        try:
            found = vector.valid_rings(pixels.repartition(3).withColumn("value", F.col("value")), "k", cols, rows, block).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
        got = {(r.k and int(r.k), r.block_id): [[(p.x, p.y) for p in ring] for ring in r.rings] for r in found}
        assert len(found) == len(got) and got == want


def test_no_call_for_each_zone(spark):
    from geoloom import catalogue

    plan = catalogue.queries()["footprint_rings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan
