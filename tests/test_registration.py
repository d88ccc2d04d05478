"""End-to-end registration in five scenarios, with a known shift to recover."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_properties import array, table
from voxelloom.operators import blocks as B
from voxelloom.operators import fields as D
from voxelloom.plans.registration import Pair, register

DIMS, BS, SHIFT = (8, 24, 24), (8, 12, 12), (0, 1, 2)
CONFIG = {"ransac": {"cc_radius": 1, "point_matches_threshold": 8, "fix_spots_count_threshold": 8, "mov_spots_count_threshold": 8, "threshold": 70.0, "max_spot_match_distance": 4.0, "align_threshold": 0.9}}


@pytest.fixture(scope="module")
def pair(spark):
    a = np.random.default_rng(11).integers(0, 100, DIMS).astype(float)
    moved = np.roll(a, SHIFT, (0, 1, 2)) * 2 + 1
    return a, table(spark, a, BS), table(spark, moved, BS)


def inner(a):
    return a[:, 2:-3, 2:-4]


def check_affine(out):
    m = np.array(out["affine"].first()["m"]).reshape(3, 4)
    np.testing.assert_allclose(m, np.hstack([np.eye(3), np.array(SHIFT)[:, None]]), atol=1e-6)
    i = np.array(out["inverse_affine"].first()["m"]).reshape(3, 4)
    np.testing.assert_allclose(i[:, 3], -np.array(SHIFT), atol=1e-6)


def test_global_and_local(pair):
    a, fix, mov = pair
    out = register(fix, mov, DIMS, BS, "ransac", None, {**CONFIG, "local_align": {"inverse_iterations": 3}})
    check_affine(out)
    np.testing.assert_allclose(inner(array(out["aligned"], DIMS)), inner(a) * 2 + 1, atol=1e-6)
    for c in D.COMPONENTS:
        np.testing.assert_allclose(inner(array(out["field"], DIMS, c)), 0, atol=1e-9)
        np.testing.assert_allclose(inner(array(out["inverse"], DIMS, c)), 0, atol=1e-9)


def test_global_local_and_further_images(pair):
    a, fix, mov = pair
    extra = mov.withColumn("image", F.lit("c0")).unionByName(mov.withColumn("v", F.transform("v", lambda v: v + 5)).withColumn("image", F.lit("c1")))
    out = register(fix, mov, DIMS, BS, "ransac", None, CONFIG, extra=extra)
    for image, add in (("c0", 0), ("c1", 5)):
        got = out["extra"].where(F.col("image") == image).drop("image")
        np.testing.assert_allclose(inner(array(got, DIMS)), inner(a) * 2 + 1 + add, atol=1e-6)


def test_further_images_only_through_the_affine(pair):
    a, fix, mov = pair
    out = register(fix, mov, DIMS, BS, "ransac", "", CONFIG, extra=mov.withColumn("image", F.lit("c0")))
    np.testing.assert_allclose(inner(array(out["extra"].drop("image"), DIMS)), inner(a) * 2 + 1, atol=1e-6)


def test_global_only(pair):
    a, fix, mov = pair
    out = register(fix, mov, DIMS, BS, "ransac", "", CONFIG)
    check_affine(out)
    assert "field" not in out
    np.testing.assert_allclose(inner(array(out["aligned"], DIMS)), inner(a) * 2 + 1, atol=1e-6)


def test_local_only(pair):
    a, fix, mov = pair
    out = register(fix, mov, DIMS, BS, "", None, CONFIG)
    for c, s in zip(D.COMPONENTS, SHIFT):
        np.testing.assert_allclose(inner(array(out["field"], DIMS, c)), s, atol=1e-9)
    np.testing.assert_allclose(inner(array(out["aligned"], DIMS)), inner(a) * 2 + 1, atol=1e-6)


def test_refinement_from_a_near_start(spark):
    from voxelloom.functions import affine as A
    from voxelloom.operators import filters as N
    from voxelloom.operators import register as R

    a = np.random.default_rng(4).normal(size=(10, 26, 26))
    a = N.smooth_array(np.pad(a, 6, mode="wrap"), [2.0] * 3)
    b = table(spark, a, (10, 13, 13))
    start = b.select("ds").distinct().select("ds", A.translation(F.lit(0.2), F.lit(0.4), F.lit(-0.5)).alias("m"))
    out = R.refine_affine(b, b, start, a.shape, (10, 13, 13), iterations=6).first()
    assert out["error"] < 0.05 * out["first_error"]
    np.testing.assert_allclose(np.array(out["m"]).reshape(3, 4)[:, 3], 0, atol=0.25)
    assert B.BLK


def test_affine_of_a_coarse_pair_serves_a_finer_one(spark):
    """Anisotropic spacing and two scales: the global affine is physical, the local pair has half the voxel size in plane."""
    fine = np.random.default_rng(3).integers(0, 100, (8, 48, 48)).astype(float)
    fine = np.repeat(np.repeat(fine[:, ::2, ::2], 2, 1), 2, 2)
    moved = np.roll(fine, (0, 2, 4), (0, 1, 2)) * 2 + 1
    coarse = [table(spark, v[:, ::2, ::2], BS) for v in (fine, moved)]
    local = Pair(table(spark, fine, (8, 24, 24)), table(spark, moved, (8, 24, 24)), (8, 48, 48), (8, 24, 24), (6.5, 0.5, 0.5), (6.5, 0.5, 0.5))
    out = register(*coarse, DIMS, BS, "ransac", "", CONFIG, spacing=(6.5, 1.0, 1.0), local=local)
    m = np.array(out["affine"].first()["m"]).reshape(3, 4)
    np.testing.assert_allclose(m, np.hstack([np.eye(3), [[0.0], [1.0], [2.0]]]), atol=1e-6)
    got = array(out["aligned"], (8, 48, 48))
    np.testing.assert_allclose(got[:, 4:-6, 4:-8], (fine * 2 + 1)[:, 4:-6, 4:-8], atol=1e-6)
