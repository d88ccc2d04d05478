"""Block-wise shifts over the whole reach of half a block."""

import numpy as np
import pytest

from tests.test_properties import array, table
from voxelloom.functions import affine as A
from voxelloom.operators import fields as D
from voxelloom.operators import local as LO

DIMS, BS = (16, 32, 32), (8, 16, 16)


@pytest.mark.parametrize("shift", [(3, 0, 0), (2, -5, 7)])
def test_shifts_in_z_and_over_two_voxels_are_found(spark, shift):
    a = np.random.default_rng(1).normal(size=DIMS)
    fix, mov = table(spark, a, BS), table(spark, np.roll(a, shift, (0, 1, 2)), BS)
    out = LO.align(fix, mov, fix.select("ds").distinct().select("ds", A.identity().alias("m")), DIMS, BS)
    assert out["transforms"].where("aligned").count() == 8
    for c, s in zip(D.COMPONENTS, shift):
        np.testing.assert_allclose(array(out["field"], DIMS, c), s, atol=1e-9)


@pytest.mark.parametrize("metric", ["ssd", "corr"])
def test_screened_shifts_hold_the_best_of_all(metric, monkeypatch):
    rng = np.random.default_rng(5)
    for case in range(20):
        reach = (2, 3, 3)
        f = rng.integers(0, 3, (5, 6, 7)).astype(float) + 1000 * (case % 3)
        m = rng.integers(0, 3, (9, 12, 13)).astype(float) + 1000 * (case % 3)
        f[:, 2 + case % 4:], m[:, :, case % 9:] = f[0, 0, 0], m[0, 0, 0]  # flat parts, so flat windows and ties
        real_f, real_m = rng.random(f.shape) < 0.9, np.ones(m.shape, dtype=bool)
        real_m[:case % 5] = False
        monkeypatch.setattr(LO, "SCREEN", 10 ** 9)
        want = min(LO._scores(f, m, real_f, real_m, reach, metric, 0.2), default=None)
        monkeypatch.setattr(LO, "SCREEN", 1)
        got = min(LO._scores(f, m, real_f, real_m, reach, metric, 0.2), default=None)
        assert got == want or np.isinf(want[0])


def wavy(shape, m=None):
    """A textured volume, seen through an affine of its index coordinates."""
    rng = np.random.default_rng(3)
    at = np.stack([p.ravel() for p in np.meshgrid(*[np.arange(n, dtype=float) for n in shape], indexing="ij")])
    if m is not None:
        at = m[:, :3] @ at + m[:, 3:]
    out = np.zeros(at.shape[1])
    for _ in range(60):
        out += rng.normal() * np.cos(rng.normal(0, 0.5, 3) @ at + rng.uniform(0, 6.3))
    return out.reshape(shape) * 10 + 100


def test_local_affines_are_recovered_per_block(spark):
    dims, bs = (12, 24, 24), (12, 12, 12)
    m = np.array([[1.0, 0.01, 0, 0.4], [-0.02, 1.02, 0.01, -0.7], [0, 0.02, 0.98, 1.1]])
    fix, mov = table(spark, wavy(dims, m) * 2 + 9, bs), table(spark, wavy(dims), bs)
    start = fix.select("ds").distinct().select("ds", A.identity().alias("m"))
    out = LO.align(fix, mov, start, dims, bs, reach=(3, 3, 3), overlap=(0, 3, 3), steps=("affine",))
    assert out["transforms"].where("aligned").count() == 4
    at = np.meshgrid(*[np.arange(n, dtype=float) for n in dims], indexing="ij")
    for i, c in enumerate(D.COMPONENTS):
        truth = sum(m[i, j] * at[j] for j in range(3)) + m[i, 3] - at[i]
        off = np.abs(array(out["field"], dims, c) - truth)[2:-2, 3:-3, 3:-3]
        assert off.mean() < 0.05 and off.max() < 0.3


def test_local_consensus_of_spots(spark):
    dims, bs = (10, 40, 40), (10, 20, 20)
    a = np.random.default_rng(7).integers(0, 100, dims).astype(float)
    fix, mov = table(spark, a, bs), table(spark, np.roll(a, (0, 1, 2), (0, 1, 2)), bs)
    start = fix.select("ds").distinct().select("ds", A.identity().alias("m"))
    options = {"ransac": {"threshold": 70.0, "cc_radius": 1, "match_threshold": 0.6, "max_spot_match_distance": 4.0, "diagonal_constraint": 0.25, "align_threshold": 0.9,
                          "confidence": 0.999, "least_share": 0.1, "fix_spots_count_threshold": 8, "mov_spots_count_threshold": 8, "point_matches_threshold": 8}}
    out = LO.align(fix, mov, start, dims, bs, reach=(2, 4, 4), overlap=(0, 4, 4), steps=("ransac",), options=options)
    assert out["transforms"].where("aligned").count() == 4
    for c, s in zip(D.COMPONENTS, (0, 1, 2)):
        np.testing.assert_allclose(array(out["field"], dims, c)[:, 4:-6, 4:-6], s, atol=1e-6)


def test_unknown_or_misplaced_steps_are_refused(spark):
    fix = table(spark, np.zeros((4, 8, 8)), (4, 8, 8))
    start = fix.select("ds").distinct().select("ds", A.identity().alias("m"))
    for steps in (("rigid",), ("deform", "affine")):
        with pytest.raises(ValueError, match="steps"):
            LO.align(fix, fix, start, (4, 8, 8), (4, 8, 8), steps=steps)
