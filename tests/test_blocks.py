"""Components and enclosed areas by blocks against the same kernels on the whole raster."""

import numpy as np
import pytest

from geoloom.operators import morphology


@pytest.mark.parametrize(("seed", "share"), [(1, 0.55), (2, 0.4), (3, 0.02)])
def test_blocks_equal_whole_raster(spark, seed, share):
    rows, cols = 23, 31  # blocks of 7, the last ones cut off
    mask = np.random.default_rng(seed).random((rows, cols)) < share
    mask[3:18, [2, 26]] = mask[[3, 17], 2:27] = True  # a ring over many blocks
    cells = spark.createDataFrame([(int(r), int(c)) for r, c in np.argwhere(mask)], "prow int, pcol int")
    found = morphology.label(mask)
    first = {k: int(np.flatnonzero(found.ravel() == k)[0]) for k in np.unique(found) if k}
    got = {(r.prow, r.pcol): r.component for r in morphology.components(cells, rows, cols, block=7).collect()}
    assert got == {(int(r), int(c)): first[found[r, c]] for r, c in np.argwhere(mask)}
    for least in (0, 3):
        inside = {(r.prow, r.pcol) for r in morphology.enclosed(cells, cols, rows, 7, least).collect()}
        assert inside == {(int(r), int(c)) for r, c in np.argwhere(morphology.interior(mask, least))}
