"""Coarse-to-fine registration, masks of the global phase, placement in rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_properties import array, table
from voxelloom.functions import affine as A
from voxelloom.operators import pyramid as Y
from voxelloom.operators import spots as P
from voxelloom.operators import stitch as S
from voxelloom.plans.registration import global_align

DIMS, BS = (8, 64, 64), (8, 32, 32)


def blobs(shift=(0.0, 0.0, 0.0)):
    """Blobs of many sizes on a fine pattern, seen through a shift."""
    rng = np.random.default_rng(4)
    z, y, x = (p + s for p, s in zip(np.meshgrid(*[np.arange(n, dtype=float) for n in DIMS], indexing="ij"), shift))
    out = 6 * np.cos(1.1 * y) * np.cos(1.2 * x)
    for _ in range(25):
        c, s = rng.uniform((0, 8, 8), (8, 56, 56)), rng.uniform(3, 7)
        out += rng.uniform(20, 60) * np.exp(-((z - c[0]) ** 2 / 20 + ((y - c[1]) ** 2 + (x - c[2]) ** 2) / (2 * s * s)))
    return out


def error(out):
    m = np.array(out.first()["m"]).reshape(3, 4)
    corners = np.array([[z, y, x, 1] for z in (0, 7) for y in (16, 48) for x in (16, 48)], dtype=float)
    return np.abs(corners @ m.T - (corners[:, :3] + [0, -7, 8])).max()


def test_a_far_start_needs_coarse_levels(spark):
    fix, mov = table(spark, blobs((0, -7, 8)), BS), table(spark, blobs(), BS)
    fine = {"affine": {"iterations": 12, "smooth": 1.0}}
    coarse = {"affine": {"iterations": 12, "shrink_factors": [4, 2, 1], "smooth_sigmas": [1.0, 1.0, 1.0]}}
    assert error(global_align(fix, mov, DIMS, BS, "affine", fine)) > 2
    assert error(global_align(fix, mov, DIMS, BS, "affine", coarse)) < 0.3


def test_a_mask_of_the_fixed_volume_keeps_a_disturbance_out(spark):
    a = blobs((0, -1, 1))
    a[:, 40:, :] = np.random.default_rng(2).normal(0, 60, a[:, 40:, :].shape)
    mask = np.ones(DIMS)
    mask[:, 38:, :] = 0
    m = table(spark, mask, BS).withColumnRenamed("v", "m")
    cfg = {"affine": {"iterations": 12, "shrink_factors": [2, 1], "smooth_sigmas": [1.0, 1.0]}}
    out = global_align(table(spark, a, BS), table(spark, blobs(), BS), DIMS, BS, "affine", cfg, mask=m)
    got = np.array(out.first()["m"]).reshape(3, 4)
    corners = np.array([[z, y, x, 1] for z in (0, 7) for y in (8, 30) for x in (8, 56)], dtype=float)
    assert np.abs(corners @ got.T - (corners[:, :3] + [0, -1, 1])).max() < 0.4


def test_center_starts_from_the_centres_of_mass(spark):
    a = np.zeros(DIMS)
    a[2:5, 10:30, 12:30] = blobs()[2:5, 10:30, 12:30] + 80
    cfg = {"affine": {"iterations": 0, "initial_condition": "CENTER"}}
    out = global_align(table(spark, a, BS), table(spark, np.roll(a, (1, 20, 17), (0, 1, 2)), BS), DIMS, BS, "affine", cfg)
    np.testing.assert_allclose(np.array(out.first()["m"]).reshape(3, 4), np.hstack([np.eye(3), [[1], [20], [17]]]), atol=1e-9)
    with pytest.raises(ValueError, match="initial"):
        global_align(table(spark, a, BS), table(spark, a, BS), DIMS, BS, "affine", {"affine": {"initial_condition": "CORNER"}})


def test_shrunk_affines_follow_the_voxels(spark):
    m = [1.1, 0.1, 0.0, 3.0, -0.2, 0.9, 0.05, 1.5, 0.0, 0.02, 1.0, -4.0]
    row = spark.range(1).select(A.shrunk(F.array(*map(F.lit, m)), (1, 2, 4)).alias("c")).select("c", A.grown(F.col("c"), (1, 2, 4)).alias("b")).first()
    np.testing.assert_allclose(row.b, m, atol=1e-12)
    full, small = np.array(m).reshape(3, 4), np.array(row.c).reshape(3, 4)
    f, i = np.array([1, 2, 4]), np.array([3.0, 5.0, 2.0])
    np.testing.assert_allclose(small[:, :3] @ i + small[:, 3], (full[:, :3] @ (f * i + (f - 1) / 2) + full[:, 3] - (f - 1) / 2) / f)


@pytest.mark.parametrize("bsize", [(4, 8, 8), (3, 5, 7)])
def test_shrinking_blocks_is_the_mean_of_voxels(spark, bsize):
    a = np.random.default_rng(0).normal(size=(5, 17, 14))
    out, small = Y.shrink(table(spark, a, bsize), bsize, (1, 2, 4))
    assert {tuple(r.bsize) for r in out.select("bsize").collect()} == {tuple(small)}
    pad = np.full((5, 18, 16), np.nan)
    pad[:, :17, :14] = a
    np.testing.assert_allclose(array(out, (5, 9, 4)), np.nanmean(pad.reshape(5, 9, 2, 4, 4), axis=(2, 4)))


def test_spots_inside_a_mask(spark):
    mask = np.zeros((4, 6, 6))
    mask[1:3, 2:5, 3:] = 1
    points = spark.createDataFrame([(0, z, y, x) for z in range(4) for y in range(6) for x in range(6)], "ds long, z long, y long, x long")
    got = P.inside(points, table(spark, mask, (3, 4, 4)).withColumnRenamed("v", "m"), (3, 4, 4))
    assert {(r.z, r.y, r.x) for r in got.collect()} == set(zip(*(i.tolist() for i in np.nonzero(mask))))


def test_placement_in_rounds_equals_one_task(spark, monkeypatch):
    rng = np.random.default_rng(9)
    tiles = spark.createDataFrame([(d, t) for d in range(2) for t in range(25)] + [(2, 0), (2, 1)], "ds long, tile_id long")
    rows = []
    for d in range(2):
        for t in range(25):
            for other in ((t + 1) if t % 5 < 4 else -1, t + 5):
                if 0 <= other < 25 and (d, t) != (1, 24):
                    rows.append((d, t, other, *rng.normal(size=2).tolist()))
    rows += [(0, 3, 99, 1.0, 1.0)]
    links = spark.createDataFrame(rows, "ds long, a_tile_id long, b_tile_id long, sy double, sx double")
    want = {(r.ds, r.tile_id): (r.dy, r.dx) for r in S.place(tiles, links).collect()}
    monkeypatch.setattr(S, "SMALL_LINKS", 0)
    got = {(r.ds, r.tile_id): (r.dy, r.dx) for r in S.place(tiles, links, tolerance=1e-7).collect()}
    assert got.keys() == want.keys()
    for k in want:
        np.testing.assert_allclose(got[k], want[k], atol=1e-5)


@pytest.mark.parametrize("bsize,scale", [((4, 8, 8), (1, 4, 4)), ((4, 6, 9), (2, 2, 3)), ((3, 5, 7), (1, 1, 1))])
def test_masks_meet_their_blocks(spark, bsize, scale):
    from voxelloom.operators import select as M

    shape = (7, 17, 20)
    rng = np.random.default_rng(1)
    a, low = rng.normal(size=shape), rng.integers(0, 2, [-(-n // s) for n, s in zip(shape, scale)]).astype(float)
    small = [b // s for b, s in zip(bsize, scale)]
    both = M.with_mask(table(spark, a, bsize), table(spark, low, small).withColumnRenamed("v", "m"), scale)
    at = np.ix_(*[np.arange(n) // s for n, s in zip(shape, scale)])
    np.testing.assert_array_equal(array(both, shape, "m"), low[at])
    with pytest.raises(Exception, match="do not fit"):
        M.with_mask(table(spark, a, (7, 17, 20)), table(spark, low, low.shape).withColumnRenamed("v", "m"), (1, 5, 5)).collect()


def round_blobs(shift=(0, 0, 0), spikes=0):
    """Blobs of different shapes at whole voxels, and single bright voxels that are none."""
    rng = np.random.default_rng(12)
    shape = (16, 48, 48)
    z, y, x = np.meshgrid(*[np.arange(n, dtype=float) for n in shape], indexing="ij")
    out = np.zeros(shape)
    for _ in range(45):
        c = rng.integers((4, 6, 6), (12, 42, 42)) + shift
        s = rng.uniform(1.3, 2.4, 3)
        out += rng.uniform(50, 90) * np.exp(-(((z - c[0]) / s[0]) ** 2 + ((y - c[1]) / s[1]) ** 2 + ((x - c[2]) / s[2]) ** 2) / 2)
    at = np.random.default_rng(100 + spikes).integers(0, shape, (spikes, 3))
    out[tuple(at.T)] += 3000
    return out


def test_blobs_and_clipping_in_the_ransac_step(spark):
    shape, bs = (16, 48, 48), (16, 24, 24)
    fix, mov = table(spark, round_blobs(spikes=30), bs), table(spark, round_blobs((1, 2, -3), spikes=31), bs)
    cfg = {"ransac": {"cc_radius": 3, "blob_sizes": [5, 8], "num_sigma_max": 3, "threshold": 3.0, "threshold_rel": 0.05, "winsorize_limits": [0.0, 0.02],
                      "match_threshold": 0.6, "max_spot_match_distance": 6.0, "align_threshold": 1.0, "fix_spots_count_threshold": 8,
                      "mov_spots_count_threshold": 8, "point_matches_threshold": 8, "mov_spot_detection_kwargs": {"blob_method": "log", "threshold": 2.5}}}
    out = global_align(fix, mov, shape, bs, "ransac", cfg)
    np.testing.assert_allclose(np.array(out.first()["m"]).reshape(3, 4), np.hstack([np.eye(3), [[1], [2], [-3]]]), atol=0.15)


def test_contexts_at_given_positions_are_those_of_the_maxima(spark):
    from voxelloom.operators import register as R

    a = np.random.default_rng(2).normal(size=(6, 14, 12))
    df = table(spark, a, (3, 7, 5))
    want = R.contexts(df, 2, 1.0)
    got = R.contexts_at(df, want.unionByName(want), 2, (3, 7, 5))
    rows = [sorted((r.z, r.y, r.x, r.v, tuple(r.patch)) for r in x.collect()) for x in (want, got)]
    assert rows[0] == rows[1] and len(rows[0]) > 5
