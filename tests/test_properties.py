"""Properties and brute-force checks on small volumes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.functions import affine as A
from voxelloom.functions.params import deep_merge, parse_vector, phase_steps, step_params
from voxelloom.operators import blocks as B
from voxelloom.operators import fields as D
from voxelloom.operators import filters as N
from voxelloom.operators import labels as L
from voxelloom.operators import local as LO
from voxelloom.operators import manifest as M
from voxelloom.operators import pyramid as P
from voxelloom.operators import register as R
from voxelloom.operators import select as S
from voxelloom.operators import spots as SP
from voxelloom.operators import stats as T
from voxelloom.operators import warp as W

DIMS = (5, 13, 18)


def volume(seed=0, dims=DIMS):
    return np.random.default_rng(seed).integers(0, 100, dims).astype(float)


def table(spark, a, bsize, ds=0, cols=("v",)):
    arrays = a if isinstance(a, list) else [a]
    z, y, x = np.indices(arrays[0].shape)
    import pandas as pd

    pdf = pd.DataFrame({"ds": ds, "z": z.ravel(), "y": y.ravel(), "x": x.ravel(), **{c: v.ravel() for c, v in zip(cols, arrays)}})
    return B.pack(spark.createDataFrame(pdf), arrays[0].shape, bsize, cols=cols)


def array(blocks, dims=DIMS, col="v"):
    out = np.full(dims, np.nan)
    pdf = B.unpack(blocks, (col,)).toPandas()
    out[pdf["z"], pdf["y"], pdf["x"]] = pdf[col]
    return out


@pytest.mark.parametrize("bsize", [(5, 13, 18), (2, 4, 7), (1, 5, 3)])
def test_pack_rechunk_unpack(spark, bsize):
    a = volume()
    b = table(spark, a, bsize)
    np.testing.assert_array_equal(array(b), a)
    np.testing.assert_array_equal(array(B.rechunk(b, (3, 5, 4))), a)


def test_halo_wider_than_blocks(spark):
    """A halo of several blocks, clipped at the border, equals the padded volume."""
    a, h = volume(), 6
    padded = np.pad(a, h, mode="edge")

    def kernel(arrays, row):
        o, n = B.core_origin(row), B.core_shape(row)
        np.testing.assert_array_equal(arrays[0], padded[tuple(slice(i, i + k + 2 * h) for i, k in zip(o, n))])
        return [N.trim(arrays[0], (h, h, h))]

    parts = B.exchange(table(spark, a, (2, 4, 5)), (h, h, h))
    np.testing.assert_array_equal(array(B.map_blocks(parts, kernel, (h, h, h))), a)


def test_pyramid_keeps_mean_and_matches_voxel_form(spark):
    a = volume(dims=(8, 16, 16))
    b = table(spark, a, (8, 8, 8))
    full = P.full(b, 3)
    for s in range(4):
        pdf = B.unpack(full.where(F.col("scale") == s)).toPandas()
        assert pdf["v"].mean() == pytest.approx(a.mean())
    voxel = P.level(B.unpack(b)).toPandas().sort_values(["z", "y", "x"])["v"].to_numpy()
    block = B.unpack(full.where("scale = 1")).toPandas().sort_values(["z", "y", "x"])["v"].to_numpy()
    np.testing.assert_allclose(block, voxel)
    with pytest.raises(Exception, match="rechunk"):
        P.full(table(spark, a, (4, 6, 8)), 3).count()


def test_quantiles_on_fine_and_hot_values(spark):
    """Doubles without repeats, and one value that holds a third of all rows."""
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=2000), np.full(1000, 0.25)])
    df = spark.createDataFrame([(int(i % 2), float(x)) for i, x in enumerate(v)], "ds bigint, v double")
    got = {r["ds"]: r for r in T.quantiles(df, [0.0, 0.31, 0.5, 0.98, 1.0], nbins=16).collect()}
    for ds in (0, 1):
        want = np.quantile(v[ds::2], [0.0, 0.31, 0.5, 0.98, 1.0])
        np.testing.assert_allclose([got[ds][f"q{i}"] for i in range(5)], want, atol=1e-12)


def test_affine_inverse_and_chain(spark):
    m = [0.9, 0.1, 0.0, 2.0, -0.2, 1.1, 0.05, -1.0, 0.0, 0.3, 0.8, 0.5]
    df = spark.range(1).select(F.array(*[F.lit(v) for v in m]).alias("m"))
    row = df.select(A.compose(F.col("m"), A.invert(F.col("m"))).alias("i")).first()
    np.testing.assert_allclose(row["i"], A.IDENTITY, atol=1e-12)
    assert spark.range(1).select(A.invert(F.array(*[F.lit(0.0)] * 12)).alias("i")).first()["i"] is None


def test_warp_by_whole_voxels_is_exact(spark):
    a = volume()
    b = table(spark, a, (2, 5, 6))
    shift = b.select("ds", *B.BLK, "dims", "bsize", A.translation(F.lit(1.0), F.lit(-2.0), F.lit(3.0)).alias("m"))
    got = array(W.warp(shift, b, DIMS, (2, 5, 6)))
    want = np.zeros(DIMS)
    want[:-1, 2:, :-3] = a[1:, :-2, 3:]
    np.testing.assert_allclose(got, want)


def test_points_meet_field_even_when_one_block_is_hot(spark):
    a = volume()
    rng = np.random.default_rng(3)
    pts = rng.uniform(-1.5, 14, (600, 3))
    pts[:400] = rng.uniform(0, 1.9, (400, 3))
    df = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(pts)], "ds bigint, point_id bigint, z double, y double, x double")
    out = W.sample_points(df, table(spark, a, (2, 4, 6)), src_bsize=(2, 4, 6), chunk=50).toPandas().set_index("point_id")["v"]
    want = W.trilinear(a, [0, 0, 0], [pts[:, i] for i in range(3)])
    assert len(out) == len(pts)
    np.testing.assert_allclose(out.sort_index().to_numpy(), want)


def _smooth_field(dims, scale):
    z, y, x = np.indices(dims)
    return [scale * np.sin(y / 5.0), scale * np.cos(x / 6.0), scale * np.sin((z + y) / 7.0)]


@pytest.mark.parametrize("options", [{}, {"step": 0.7, "iterations": [10, 20]}, {"use_root": True, "iterations": 15}])
def test_field_and_inverse_cancel(spark, options):
    dims = (9, 20, 20)
    f = table(spark, _smooth_field(dims, 0.6), (9, 10, 10), cols=D.COMPONENTS)
    inv = D.invert(f, **{"iterations": 20, **options})
    both = D.compose(inv, f, dims, (9, 10, 10))
    inner = B.unpack(both, D.COMPONENTS).where("z between 2 and 6 and y between 3 and 16 and x between 3 and 16")
    worst = inner.agg(*[F.max(F.abs(c)) for c in D.COMPONENTS]).first()
    assert max(worst) < 0.02


def test_inverse_does_not_depend_on_blocks(spark):
    dims = (6, 14, 14)
    got = [array(D.invert(table(spark, _smooth_field(dims, 1.4), bs, cols=D.COMPONENTS), 5, smooth=0.5), dims, "dy")
           for bs in ((6, 14, 14), (3, 4, 5))]
    np.testing.assert_allclose(got[0], got[1], atol=1e-12)


def test_blend_of_equal_transforms_is_that_transform(spark):
    base = B.block_skeleton(spark.range(1).select(F.col("id").alias("ds")), DIMS, (5, 4, 6))
    t = base.withColumn("m", A.translation(F.lit(0.5), F.lit(-1.0), F.lit(2.0)))
    got = B.unpack(D.blend(t, DIMS, (5, 4, 6), (0, 2, 2)), D.COMPONENTS).toPandas()
    assert len(got) == np.prod(DIMS)
    np.testing.assert_allclose(got[list(D.COMPONENTS)].to_numpy(), [[0.5, -1.0, 2.0]] * len(got))


def brute_components(mask):
    label, seen = np.zeros(mask.shape, dtype=int), set()
    for start in map(tuple, np.argwhere(mask)):
        if start in seen:
            continue
        name, stack = np.ravel_multi_index(start, mask.shape) + 1, [start]
        seen.add(start)
        while stack:
            p = stack.pop()
            label[p] = name
            for ax in range(3):
                for d in (-1, 1):
                    q = list(p)
                    q[ax] += d
                    q = tuple(q)
                    if all(0 <= c < n for c, n in zip(q, mask.shape)) and mask[q] and q not in seen:
                        seen.add(q)
                        stack.append(q)
    return label


@pytest.mark.parametrize("bsize,overlap", [((2, 3, 4), (0, 0, 0)), ((5, 5, 5), (1, 2, 1)), ((5, 13, 18), (0, 0, 0))])
def test_merged_labels_do_not_depend_on_blocks(spark, bsize, overlap):
    a = volume(7)
    got = array(L.merge(L.segment(table(spark, a, bsize), "threshold", overlap, threshold=66.0)))
    np.testing.assert_array_equal(got, brute_components(a > 66))


def test_long_chain_becomes_one_component(spark):
    """A snake through all blocks, and a star, in one graph."""
    edges = [(0, i, i + 1) for i in range(1, 200)] + [(1, 5, i) for i in range(6, 300)]
    out = L.components(spark.createDataFrame(edges, "ds bigint, a bigint, b bigint")).toPandas()
    assert out.groupby("ds")["root"].agg(["min", "max", "count"]).values.tolist() == [[1, 1, 200], [5, 5, 295]]


def test_all_ones_mask_changes_nothing(spark):
    a = volume(7)
    seg = L.segment(table(spark, a, (2, 5, 6)), "threshold", threshold=60.0)
    ones = table(spark, np.ones(DIMS), (2, 5, 6), cols=("m",))
    np.testing.assert_array_equal(array(L.merge(seg)), array(L.merge(seg, mask=ones)))
    np.testing.assert_array_equal(array(S.apply_mask_blocks(table(spark, a, (2, 5, 6)), ones)), a)


def test_spots_do_not_depend_on_blocks(spark):
    a = N.smooth_array(np.pad(volume(3), 3, mode="edge"), [1.0] * 3)
    found = []
    for bs in ((5, 13, 18), (2, 4, 5)):
        b = table(spark, a, bs)
        log = SP.detect_log(b, [0.7, 1.0], 0.1, 0.05).drop("v").toPandas().sort_values(["z", "y", "x", "sigma"]).to_numpy()
        rad = SP.detect_radial(b, 40.0).toPandas().sort_values(["cz", "cy", "cx"]).to_numpy()
        found.append((log, rad))
    assert len(found[0][0]) and len(found[0][1])
    for i in range(2):
        np.testing.assert_allclose(found[0][i], found[1][i], atol=1e-9)


def test_radial_centre_of_a_shifted_gaussian(spark):
    z, y, x = np.indices((9, 11, 11))
    c = (4.3, 5.2, 4.8)
    a = 100 * np.exp(-((z - c[0]) ** 2 + (y - c[1]) ** 2 + (x - c[2]) ** 2) / (2 * 1.5**2))
    row = SP.detect_radial(table(spark, a, (5, 6, 6)), 50.0).toPandas()
    np.testing.assert_allclose(row[["z", "y", "x"]].to_numpy(), [c], atol=0.1)


def test_strongest_equals_sort(spark):
    rng = np.random.default_rng(0)
    rows = [(0 if i % 3 else 1, i, int(rng.integers(9)), int(rng.integers(9)), float(rng.integers(30))) for i in range(500)]
    df = spark.createDataFrame(rows, "ds bigint, z bigint, y bigint, x bigint, v double")
    got = SP.strongest(df, 40, slice_rows=80).toPandas()
    for ds in (0, 1):
        want = sorted([r for r in rows if r[0] == ds], key=lambda r: (-r[4], r[1], r[2], r[3]))[:40]
        assert [tuple(r) for r in got[got.ds == ds].sort_values("rank")[["ds", "z", "y", "x", "v"]].to_numpy()] == want


def test_rank_over_slices(spark):
    """Order values far apart and dense, one key with most rows."""
    vals = sorted({*range(0, 3000), *range(10**6, 10**6 + 50), 2**40, 2**40 + 1})
    rows = [("hot", v) for v in vals] + [("cold", 7), ("cold", 2**33)]
    out = M.rank_in_group(spark.createDataFrame(rows, "k string, o bigint"), ["k"], "o", bits=8).toPandas()
    hot = out[out.k == "hot"].sort_values("o")
    assert hot["rn"].tolist() == list(range(1, len(vals) + 1))
    assert out[out.k == "cold"].sort_values("o")["rn"].tolist() == [1, 2]


def test_group_parts_hold_every_member(spark):
    df = spark.range(1000).select(F.lit("a").alias("k"), F.col("id").alias("o"), F.col("id").cast("string").alias("p"))
    parts = M.group_parts(df, "k", "o", "p", part_size=64).toPandas().sort_values("part")
    assert parts["n"].max() == 64 and sum(parts["p"].map(list), []) == [str(i) for i in range(1000)]


def test_unique_keys_are_checked(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "meta_id string, n int")
    with pytest.raises(ValueError, match="duplicate"):
        M.join_by_key(df, df, check=True)


def test_common_parent_edge_cases(spark):
    rows = [("a", "/x/y/z"), ("a", "/x/y"), ("b", "/x/y/z"), ("c", "/p/q"), ("c", "/r/q"), ("d", "/x/ya"), ("d", "/x/yb")]
    got = dict(M.common_parent(spark.createDataFrame(rows, "k string, p string"), "k", "p").collect())
    assert got == {"a": "/x/y", "b": "/x/y/z", "c": "", "d": "/x"}


def test_absent_options_and_index_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "t int, c int")
    assert S.by_time(df, 0).count() == 2 and S.by_time(df, None).count() == 3
    assert S.by_channel(df, 0).count() == 2 and S.by_channels(df, []).count() == 3


def test_parameters():
    cfg = {"ransac": {"nspots": 5000, "fix": {"method": "log", "rel": 0.05}}, "local": {"steps": ["ransac"], "ransac": {"fix": {"rel": 0.1}}}}
    assert step_params(cfg, "local", "ransac") == {"nspots": 5000, "fix": {"method": "log", "rel": 0.1}}
    assert phase_steps(cfg, "local", "affine, deform") == ["affine", "deform"] and phase_steps(cfg, "local", "") == ["ransac"]
    assert parse_vector("1.0,1.0,6.5") == [6.5, 1.0, 1.0] and parse_vector("") is None
    assert deep_merge({"a": 1}, {"a": None, "b": 0}) == {"a": 1, "b": 0}


def test_ransac_ignores_outliers(spark):
    rng = np.random.default_rng(5)
    f = rng.uniform(0, 60, (120, 3))
    m = np.array([[1.0, 0.02, 0, 3], [-0.03, 0.98, 0, -2], [0, 0.01, 1.01, 1]])
    t = f @ m[:, :3].T + m[:, 3]
    t[80:] += rng.uniform(10, 30, (40, 3))
    df = spark.createDataFrame([(0, *map(float, a), *map(float, b)) for a, b in zip(f, t)], "ds bigint, fz double, fy double, fx double, mz double, my double, mx double")
    out = R.ransac(df, 0.5).first()
    assert out["inliers"] == 80
    np.testing.assert_allclose(np.array(out["m"]).reshape(3, 4), m, atol=1e-6)


def test_failed_blocks_keep_the_identity(spark):
    a = volume(2, (4, 16, 16))
    a[:, :8, :8] = 0  # flat: no block shift can be found
    b = table(spark, a, (4, 8, 8))
    shifted = table(spark, np.roll(a, (0, 1, 1), (0, 1, 2)), (4, 8, 8))
    found = LO.block_shifts(b, shifted, (0, 2, 2), metric="corr").toPandas()
    assert len(found) == 3 and found[["dz", "dy", "dx"]].to_numpy().tolist() == [[0, 1, 1]] * 3
