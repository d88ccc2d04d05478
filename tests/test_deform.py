"""Control-point fields: cell algebra, refinement, and recovery of known fields."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_properties import array, table
from voxelloom.functions import affine as A
from voxelloom.operators import deform as Q
from voxelloom.operators import fields as D
from voxelloom.operators import warp as W

SHAPE = (12, 24, 28)


def texture(shape=SHAPE, seed=0, d=(0, 0, 0)):
    """A smooth volume with detail everywhere, seen through a displacement."""
    rng = np.random.default_rng(seed)
    z, y, x = (p + q for p, q in zip(np.meshgrid(*[np.arange(n, dtype=float) for n in shape], indexing="ij"), d))
    out = np.zeros(shape)
    for _ in range(60):
        k = rng.normal(0, 0.45, 3)
        out += rng.normal() * np.cos(k[0] * z + k[1] * y + k[2] * x + rng.uniform(0, 6.3))
    return out * 20 + 500


def known(shape=SHAPE):
    """A smooth displacement of fractions of voxels, up to about one and a half."""
    z, y, x = np.meshgrid(*[np.arange(n, dtype=float) for n in shape], indexing="ij")
    return [0.6 * np.sin(y / 7.0) * np.cos(z / 9.0), 1.3 * np.cos(x / 9.0 + 0.4), 1.2 * np.sin((y + z) / 8.0) - 0.3]


def test_cell_equations_equal_the_full_matrix():
    rng = np.random.default_rng(2)
    shape, spacing = (5, 6, 4), 6
    v, w, use = rng.normal(size=shape), rng.normal(size=shape), rng.integers(0, 2, shape).astype(float)
    grads = rng.normal(size=(3, *shape))
    weights = [D.bspline_weights(np.arange(n) / spacing) for n in shape]
    basis = np.einsum("az,by,cx->abczyx", *weights).reshape(64, -1)
    jacobian = np.concatenate([basis * g.ravel() for g in grads])
    g, h = Q.normal_cell(v, w, use, grads, spacing)
    full = (jacobian * use.ravel()) @ jacobian.T
    np.testing.assert_allclose(g, (jacobian * use.ravel()) @ (v - w).ravel(), atol=1e-9)
    np.testing.assert_allclose(Q.diagonal(h).ravel(), np.diag(full), atol=1e-9)
    p = rng.normal(size=(3, 64))
    np.testing.assert_allclose(Q.product(h, p).ravel(), full @ p.ravel(), atol=1e-9)
    flat = np.ones((3, 64))
    np.testing.assert_allclose(flat @ Q.BENDING, 0)


def test_halving_the_spacing_keeps_the_field(spark):
    ids = spark.createDataFrame([(0,)], "ds long")
    controls = Q.lattice(ids, (9, 17, 13), 8).withColumns({c: F.sin(F.col("cz") * 3 + F.col("cy") * (i + 2) + F.col("cx")) for i, c in enumerate(D.COMPONENTS)})
    fine = Q.refine(controls, (9, 17, 13), 8)
    for c in D.COMPONENTS:
        a = array(Q.field(controls, (9, 17, 13), (9, 17, 13), 8), (9, 17, 13), c)
        np.testing.assert_allclose(array(Q.field(fine, (9, 17, 13), (4, 5, 6), 4), (9, 17, 13), c), a, atol=1e-9)


def test_a_known_smooth_field_is_recovered_for_any_block_size(spark):
    d, found = known(), []
    start = spark.createDataFrame([(0,)], "ds long").select("ds", A.identity().alias("m"))
    for bsize in ((12, 24, 28), (5, 8, 9)):
        fix, mov = table(spark, texture(d=d) * 3 + 5, bsize), table(spark, texture(), bsize)
        field = Q.field(Q.fit(fix, mov, start, SHAPE, bsize, 12, (1, 2), (1.0, 0.0), iterations=3), SHAPE, bsize, 6)
        found.append([array(field, SHAPE, c) for c in D.COMPONENTS])
    for one, other, truth in zip(*found, d):
        np.testing.assert_allclose(one, other, atol=1e-6)
        off = np.abs(one - truth)[2:-2, 3:-3, 3:-3]
        assert off.mean() < 0.06 and np.percentile(off, 99) < 0.25 and off.mean() < 0.2 * np.abs(truth).mean()


def test_rounds_equal_the_solution_in_one_task(spark, monkeypatch):
    a, d = texture(), known()
    fix, mov = table(spark, texture(d=d), (12, 24, 28)), table(spark, a, (12, 24, 28))
    start = spark.createDataFrame([(0,)], "ds long").select("ds", A.identity().alias("m"))
    out = []
    for limit in (Q.SMALL_CELLS, 0):
        monkeypatch.setattr(Q, "SMALL_CELLS", limit)
        c = Q.fit(fix, mov, start, SHAPE, (12, 24, 28), 12, iterations=1, rounds=4)
        out.append(np.array([list(r) for r in c.orderBy(*Q.CONTROL).collect()], dtype=float))
    np.testing.assert_allclose(out[0], out[1], atol=1e-7)


def test_small_datasets_write_no_equations(spark, monkeypatch):
    a, d, seen = texture(), known(), []
    fix, mov = table(spark, texture(d=d), (12, 24, 28)), table(spark, a, (12, 24, 28))
    start = spark.createDataFrame([(0,)], "ds long").select("ds", A.identity().alias("m"))
    for name in ("cut", "written"):
        keep = getattr(Q, name)
        monkeypatch.setattr(Q, name, lambda df, *more, keep=keep: seen.append(df.columns) or keep(df, *more))
    Q.fit(fix, mov, start, SHAPE, (12, 24, 28), 12, iterations=1, rounds=2)
    assert seen and not any("h" in columns for columns in seen)


def test_cells_of_many_runs_solve_as_one(monkeypatch):
    rng = np.random.default_rng(4)
    shape, cells = (4, 5, 6), 6
    places = np.array([np.ravel_multi_index(np.unravel_index(np.arange(64), (4, 4, 4)), shape) + np.ravel_multi_index((0, i, j), shape) for i in range(2) for j in range(3)])
    made = [Q.normal_cell(*(rng.normal(size=(6, 6, 6)) for _ in range(2)), np.ones((6, 6, 6)), rng.normal(size=(3, 6, 6, 6)), 6) for _ in range(cells)]
    rights, matrices = np.stack([g for g, _ in made]).reshape(-1, 3, 64), [h for _, h in made]
    out = []
    for size in (64, 4):
        monkeypatch.setattr(Q, "WRITTEN_OUT", size)
        out.append(Q._solve_small(rights, matrices, places, rng.normal(size=(3, 120)) * 0, 0.1, 5, 0.0, 0.02))
    np.testing.assert_allclose(*out, atol=1e-12)
    p = rng.normal(size=(3, 64))
    np.testing.assert_allclose(Q.products(matrices[0][Q.FULL][None], p[None])[0], Q.product(matrices[0], p), atol=1e-9)


def test_ends_of_a_field_change_nothing(spark):
    d = known()
    field = table(spark, d[0], (5, 8, 9)).withColumnsRenamed({"v": "dz"})
    for c, values in zip(("dy", "dx"), d[1:]):
        field = field.join(table(spark, values, (5, 8, 9)).select("ds", "blk_z", "blk_y", "blk_x", F.col("v").alias(c)), ["ds", "blk_z", "blk_y", "blk_x"])
    field = field.withColumn("m", A.translation(F.lit(0.5), F.lit(-1.0), F.lit(0.25)))
    mov, ends = table(spark, texture(), (6, 7, 8)), W.field_ends(D.COMPONENTS)
    want = array(W.warp(field, mov, SHAPE, (6, 7, 8), field=D.COMPONENTS), SHAPE)
    got = array(W.warp(field.withColumns(ends), mov, SHAPE, (6, 7, 8), field=D.COMPONENTS, ends=list(ends)), SHAPE)
    np.testing.assert_array_equal(got, want)


def test_masked_and_flat_volumes_stay_where_they_are(spark):
    a, d = texture(), known()
    fix, mov = table(spark, np.zeros(SHAPE), (12, 24, 28)), table(spark, a, (12, 24, 28))
    start = spark.createDataFrame([(0,)], "ds long").select("ds", A.identity().alias("m"))
    assert Q.fit(fix, mov, start, SHAPE, (12, 24, 28), 12, iterations=2).agg(F.max(F.abs("dz") + F.abs("dy") + F.abs("dx"))).first()[0] == 0
    mask = table(spark, np.zeros(SHAPE), (12, 24, 28)).withColumnRenamed("v", "m")
    out = Q.fit(table(spark, texture(d=d), (12, 24, 28)), mov, start, SHAPE, (12, 24, 28), 12, iterations=2, mask=mask)
    assert out.agg(F.max(F.abs("dy"))).first()[0] == 0


def test_wrong_levels_are_refused(spark):
    df = table(spark, np.zeros(SHAPE), (12, 24, 28))
    for factors in ((3,), (2, 1), (1, 8)):
        with pytest.raises(ValueError):
            Q.fit(df, df, df, SHAPE, (12, 24, 28), 12, factors, (1.0,) * len(factors))
