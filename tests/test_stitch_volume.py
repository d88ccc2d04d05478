"""Shifts of overlapping tiles in three axes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_properties import table
from voxelloom.operators import stitch as S


def tiles_of(spark, truth, nominal, shape, size, seed=0):
    """Tiles cut out of one volume at their true origins, and the table with their nominal ones."""
    whole = np.random.default_rng(seed).normal(size=shape)
    blocks, rows = None, []
    for t, (o, n) in enumerate(zip(truth, nominal)):
        a = whole[tuple(slice(i, i + k) for i, k in zip(o, size))]
        part = table(spark, a, (3, 5, 4)).withColumn("tile_id", F.lit(t).cast("bigint"))
        blocks = part if blocks is None else blocks.unionByName(part)
        rows.append((0, t, *n, *size))
    return whole, blocks, spark.createDataFrame(rows, "ds long, tile_id long, z0 long, y0 long, x0 long, d long, h long, w long")


def test_stage_errors_of_many_voxels_are_recovered(spark):
    truth = [(2, 3, 4), (2, 13, 4), (3, 3, 16), (5, 14, 15)]
    nominal = [(2, 3, 4), (4, 10, 7), (0, 5, 12), (4, 17, 18)]
    _, blocks, tiles = tiles_of(spark, truth, nominal, (20, 40, 40), (9, 16, 17))
    scores = S.shift_volumes(S.overlap_boxes(tiles, (9, 16, 17)), blocks, (3, 5, 4), (5, 7, 7), (4, 6, 5))
    got = {(r.a_tile_id, r.b_tile_id): ((r.sz, r.sy, r.sx), r.r) for r in S.best_shift_volume(scores, 60).collect()}
    assert len(got) >= 5
    for (a, b), (shift, r) in got.items():
        # content at nominal g of a lies at true g + e_a, and at nominal g + s of b
        want = tuple((nominal[b][i] - truth[b][i]) - (nominal[a][i] - truth[a][i]) for i in range(3))
        assert shift == want and r > 0.999


@pytest.mark.parametrize("chunk", [(3, 4, 5), (50, 50, 50)])
def test_sums_equal_direct_counting(spark, chunk):
    _, blocks, tiles = tiles_of(spark, [(0, 0, 0), (1, 3, 4)], [(0, 0, 0), (1, 4, 3)], (8, 14, 14), (6, 9, 8), 3)
    pairs = S.overlap_boxes(tiles, (6, 9, 8))
    box = pairs.first()
    whole = np.random.default_rng(3).normal(size=(8, 14, 14))
    a, b = whole[0:6, 0:9, 0:8], whole[1:7, 3:12, 4:12]
    low, high = [box[f"lo_{c}"] for c in "zyx"], [box[f"hi_{c}"] for c in "zyx"]
    seen = 0
    for r in S.shift_volumes(pairs, blocks, (3, 5, 4), (1, 2, 3), chunk).collect():
        s, x, y = (r.sz, r.sy, r.sx), [], []
        for g in np.ndindex(*[h - v for h, v in zip(high, low)]):
            at = [v + i for v, i in zip(low, g)]
            other = [v + i - o for v, i, o in zip(at, s, (1, 4, 3))]
            if all(0 <= i < n for i, n in zip(other, b.shape)):
                x.append(a[tuple(at)])
                y.append(b[tuple(other)])
        x, y = np.array(x), np.array(y)
        np.testing.assert_allclose([r.n, r.sa, r.sb, r.saa, r.sbb, r.sab], [len(x), x.sum(), y.sum(), (x * x).sum(), (y * y).sum(), (x * y).sum()], atol=1e-8)
        seen += 1
    assert seen == 3 * 5 * 7


def test_boxes_meet_in_three_axes_only(spark):
    rows = [(0, 0, 0, 0, 0, 4, 8, 8), (0, 1, 3, 6, 6, 4, 8, 8), (0, 2, 4, 0, 0, 4, 8, 8), (1, 0, 0, 0, 0, 4, 8, 8)]
    tiles = spark.createDataFrame(rows, "ds long, tile_id long, z0 long, y0 long, x0 long, d long, h long, w long")
    got = {(r.ds, r.a_tile_id, r.b_tile_id): (r.lo_z, r.hi_z, r.lo_y, r.hi_y, r.lo_x, r.hi_x) for r in S.overlap_boxes(tiles, (4, 8, 8)).collect()}
    assert got == {(0, 0, 1): (3, 4, 6, 8, 6, 8), (0, 1, 2): (4, 7, 6, 8, 6, 8)}
