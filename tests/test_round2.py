"""Checks of single operators: gaps, missing blocks, repeated ids, page orders, containers, refinement by block size."""

import itertools
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_properties import array, table
from voxelloom.functions import affine as A
from voxelloom.operators import labels as L
from voxelloom.operators import register as R
from voxelloom.operators import select as S
from voxelloom.operators import stitch as ST
from voxelloom.operators import warp as W
from voxelloom.session import shared_dir
from voxelloom.sources import chunked as C
from voxelloom.sources import files as FS
from voxelloom.sources import images as I


def test_lines_fill_gaps(spark):
    vox = spark.createDataFrame([(0, 0, 0, 0, x, float(x * x)) for x in (0, 1, 3, 4)], "ds long, tile_id long, z long, y long, x long, v double")
    assert ST.lines(vox).first().line == [0.0, 1.0, 0.0, 9.0, 16.0]


def test_placement_is_the_least_squares_solution():
    rng = np.random.default_rng(4)
    n = 60
    pairs = np.array([(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.08 or b == a + 1])
    shift = rng.normal(size=(len(pairs), 2))
    got = ST.solve_places(np.arange(n), pairs[:, 0], pairs[:, 1], shift, 0, 1e-12)
    left = np.zeros((len(pairs), n))
    left[np.arange(len(pairs)), pairs[:, 0]], left[np.arange(len(pairs)), pairs[:, 1]] = 1, -1
    want = np.linalg.lstsq(left[:, 1:], shift, rcond=None)[0]
    np.testing.assert_allclose(got[1:], want, atol=1e-7)
    assert (got[0] == 0).all()


def test_blocks_without_a_mask_become_zero(spark):
    a = np.arange(1.0, 4 * 8 * 8 + 1).reshape(4, 8, 8)
    blocks = table(spark, a, (4, 4, 4))
    mask = table(spark, np.ones_like(a), (4, 4, 4)).where("blk_x = 0").withColumnRenamed("v", "m")
    out = array(S.apply_mask_blocks(blocks, mask), a.shape)
    assert (out[:, :, :4] == a[:, :, :4]).all() and (out[:, :, 4:] == 0).all()


def test_repeated_point_ids_stay_single_rows(spark):
    field = table(spark, np.zeros((4, 8, 8)), (4, 4, 4))
    field = field.select("ds", "blk_z", "blk_y", "blk_x", "dims", "bsize", *[F.transform("v", lambda v: v + 1.0).alias(c) for c in ("dz", "dy", "dx")])
    pts = spark.createDataFrame([(0, 7, 1.0, 2.0, 3.0, "a"), (0, 7, 1.0, 2.0, 3.0, "a"), (0, 7, 2.0, 2.0, 2.0, None)],
                                "ds long, point_id long, z double, y double, x double, note string")
    out = sorted((r.z, r.y, r.x, r.note or "") for r in W.transform_coords(pts, field=field, field_bsize=(4, 4, 4)).collect())
    assert out == [(2.0, 3.0, 4.0, "a"), (2.0, 3.0, 4.0, "a"), (3.0, 3.0, 3.0, "")]


@pytest.mark.parametrize("order", ["".join(p) for p in itertools.permutations("CZT")])
def test_tiff_pages_follow_the_stated_order(spark, tmp_path, order):
    size = {"C": 2, "Z": 3, "T": 2}
    pages = []
    for i in itertools.product(*[range(size[a]) for a in reversed(order)]):
        at = dict(zip(reversed(order), i))
        pages.append(np.full((2, 3), 100 * at["T"] + 10 * at["C"] + at["Z"], np.uint16))
    text = f'<Pixels DimensionOrder="XY{order}" SizeC="2" SizeZ="3" SizeT="2"/>'
    (tmp_path / "a.tif").write_bytes(I.encode_tiff(pages, description=text))
    for r in I.read_tiff(spark, f"{tmp_path}/*.tif").collect():
        assert set(r.v) == {100.0 * r.t + 10 * r.c + r.blk_z}


def test_unread_tiff_layouts_raise(tmp_path):
    page = I.encode_tiff([np.zeros((2, 2), np.uint8)])
    at = struct.unpack_from("<I", page, 4)[0]
    for tag, value in ((I.SAMPLES, 3), (I.PREDICTOR, 2), (I.TILE_WIDTH, 16)):
        bad = bytearray(page)
        struct.pack_into("<HHII", bad, at + 2 + 12 * 6, tag, 3, 1, value)  # in place of the sample format
        (tmp_path / "b.tif").write_bytes(bad)
        with pytest.raises(ValueError, match="not supported"):
            I.tiff_pages(str(tmp_path / "b.tif"))


@pytest.mark.parametrize("fmt", ["n5", "zarr"])
def test_container_reads_only_its_chunks_and_replaces_old_ones(spark, tmp_path, fmt):
    big, small = np.arange(1.0, 513).reshape(8, 8, 8), np.arange(1.0, 65).reshape(4, 4, 4)
    root = str(tmp_path)
    C.write(table(spark, big, (4, 4, 4)), root, F.lit("a/s0"), fmt)
    C.write(table(spark, big, (4, 4, 4)), root, F.lit("a/s1"), fmt)
    for f in (tmp_path / "a" / "s1").rglob("*"):
        if f.is_file() and f.name[0] not in ".a":
            f.write_bytes(b"broken")
    back = C.read(spark, root, fmt, "a/s0").withColumn("ds", F.lit(0))
    assert (array(back, big.shape) == big).all()
    C.write(table(spark, small, (4, 4, 4)), root, F.lit("a/s0"), fmt)
    back = C.read(spark, root, fmt, "s0").withColumn("ds", F.lit(0))
    assert back.count() == 1 and (array(back, small.shape) == small).all()


def test_paths_without_a_scheme_get_the_default_file_system(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    old = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "hdfs://name:8020/")
        assert FS.qualified(spark, "/data/a.n5") == "hdfs://name:8020/data/a.n5"
        assert FS.qualified(spark, "s3a://b/a.n5") == "s3a://b/a.n5"
    finally:
        conf.set("fs.defaultFS", old)
    assert FS.qualified(spark, "/data/a.n5") == "/data/a.n5"


def test_a_cluster_without_a_shared_folder_is_refused():
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: None)})()
        sparkContext = type("S", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="executors share"):
        shared_dir(Session())


def smooth_volume(shape):
    z, y, x = np.meshgrid(*[np.arange(n) for n in shape], indexing="ij")
    return 50 * np.sin(z / 2.5) + 40 * np.cos(y / 4.0 + x / 9.0) + 30 * np.sin(x / 3.5)


@pytest.mark.parametrize("bsize", [(10, 24, 24), (5, 6, 8)])
def test_refinement_recovers_a_known_affine_for_any_block_size(spark, bsize):
    a = smooth_volume((10, 24, 24))
    fix = table(spark, a, bsize)
    start = spark.createDataFrame([(0,)], "ds long").select("ds", A.translation(F.lit(0.3), F.lit(-0.4), F.lit(0.6)).alias("m"))
    out = R.refine_affine(fix, fix.withColumn("v", F.transform("v", lambda v: v * 3 + 7)), start, a.shape, bsize, margin=(1, 2, 2)).first()
    np.testing.assert_allclose(np.array(out.m).reshape(3, 4), np.eye(3, 4), atol=0.02)
    assert out.error < out.first_error


def test_consensus_survives_many_outliers(spark):
    rng = np.random.default_rng(8)
    f = rng.integers(0, 200, (400, 3))
    m = f + np.array([3, -2, 5])
    m[120:] = rng.integers(0, 200, (280, 3))
    df = spark.createDataFrame(pd.DataFrame(np.hstack([np.zeros((400, 1), int), f, m]), columns=["ds", *R.FIX, *R.MOV]))
    out = R.ransac(df, 2.0).first()
    np.testing.assert_allclose(np.array(out.m).reshape(3, 4), np.hstack([np.eye(3), [[3], [-2], [5]]]), atol=1e-6)
    assert out.inliers >= 120


@pytest.mark.parametrize("bsize", [(4, 8, 8), (4, 4, 2), (1, 8, 8)])
def test_masked_labels_do_not_depend_on_the_block_size(spark, bsize):
    a = np.zeros((4, 8, 8))
    a[1, 2, :], a[2, 5:, 3] = 1, 1
    mask = np.ones_like(a)
    mask[:, :, 4] = 0
    labels = L.segment(table(spark, a, bsize), "threshold", threshold=0.5)
    got = array(L.merge(labels, mask=table(spark, mask, bsize).withColumnRenamed("v", "m")), a.shape)
    want = L.connected((a > 0) & (mask > 0))
    assert (got == want).all()
