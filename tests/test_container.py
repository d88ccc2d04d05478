"""Containers: any rank, pushed filters, pyramids, replacement that loses nothing."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_properties import array, table, volume
from voxelloom.operators import labels as L
from voxelloom.sources import chunked as C
from voxelloom.sources import container as N


def five(spark, a, bsize):
    out = None
    for t in range(a.shape[0]):
        for c in range(a.shape[1]):
            part = table(spark, a[t, c], bsize).withColumns({"t": F.lit(t), "c": F.lit(c)})
            out = part if out is None else out.unionByName(part)
    return out


@pytest.mark.parametrize("fmt,codec", [("n5", "gzip"), ("zarr", "zlib")])
def test_five_axes_and_filters_open_only_their_chunks(spark, tmp_path, fmt, codec):
    a = np.random.default_rng(1).integers(0, 60000, (2, 3, 4, 6, 7)).astype(float)
    assert C.write(five(spark, a, (2, 3, 4)), str(tmp_path), F.lit("x/s0"), fmt, "uint16", codec, lead=("t", "c")) == 6 * 8
    C.write(table(spark, a[0, 0], (2, 3, 4)), str(tmp_path), F.lit("y/s0"), fmt)
    df = N.read(spark, str(tmp_path), fmt, axes="tczyx")
    for t in range(2):
        for c in range(3):
            one = df.where((F.col("folder") == "x/s0") & (F.col("t") == t) & (F.col("c") == c)).withColumn("ds", F.lit(0))
            np.testing.assert_array_equal(array(one, a.shape[2:]), a[t, c])
    lone = df.where("folder = 'y/s0'").collect()
    assert len(lone) == 8 and all(r.t is None and r.c is None for r in lone)
    keep = {C.chunk_name((1, c, 1, y, x), fmt) for c in (0, 2) for y in range(2) for x in range(2)}
    for f in (tmp_path / "x" / "s0").rglob("*"):
        name = str(f.relative_to(tmp_path / "x" / "s0"))
        if f.is_file() and name not in ("attributes.json", ".zarray") and name not in keep:
            f.write_bytes(b"broken")
    got = df.where("folder like '%x/s0' and t > 0 and c in (0, 2) and blk_z >= 1 and blk_x < 9").collect()
    assert len(got) == 8 and {(r.t, r.c, r.blk_z) for r in got} == {(1, 0, 1), (1, 2, 1)}
    assert df.where("folder = 'x/s0' and t = 5").count() == 0 and df.where("folder = 'none'").count() == 0
    with pytest.raises(Exception):
        df.where("folder = 'x/s0'").collect()


def test_filters_inside_a_chunk_of_many_channels(spark, tmp_path):
    """A chunk by hand that holds two channels, in an image without time."""
    a = np.arange(2 * 2 * 2 * 3, dtype="uint16").reshape(2, 2, 2, 3)
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [3, 2, 2, 3], "chunks": [2, 2, 2, 3], "dtype": "<u2", "compressor": None,
                                                        "fill_value": 0, "order": "C", "filters": None}))
    (tmp_path / "i" / "0.0.0.0").write_bytes(a.tobytes())
    (tmp_path / "i" / "1.0.0.0").write_bytes(a.tobytes())
    df = N.read(spark, str(tmp_path), "zarr")
    assert [(r.t, r.c, r.v[0]) for r in df.orderBy("c").collect()] == [(None, 0, 0.0), (None, 1, 12.0), (None, 2, 0.0)]
    assert [(r.c, r.dims) for r in df.where("c = 1").collect()] == [(1, [2, 2, 3])]
    assert df.where("t = 0").count() == 0


def test_no_datasets(spark, tmp_path):
    assert N.read(spark, str(tmp_path), "zarr").count() == 0


@pytest.mark.parametrize("fmt", ["n5", "zarr"])
def test_pyramid_levels_and_metadata(spark, tmp_path, fmt):
    a = volume(3, (7, 20, 9))
    n = N.write_pyramid(table(spark, a, (4, 8, 4)), str(tmp_path), F.lit("img"), 2, fmt, "float64", spacing=(2.0, 0.5, 0.5))
    assert n == 2 * 3 * 3 + 1 * 2 * 2 + 1 * 1 * 1
    want = a
    for s in range(3):
        got = C.read(spark, str(tmp_path), fmt, f"img/s{s}").withColumn("ds", F.lit(0))
        assert {tuple(r.bsize) for r in got.select("bsize").collect()} == {(4, 8, 4)}
        np.testing.assert_allclose(array(got, want.shape), want)
        pad = np.full([2 * -(-d // 2) for d in want.shape], np.nan)
        pad[tuple(slice(0, d) for d in want.shape)] = want
        want = np.nanmean(pad.reshape(pad.shape[0] // 2, 2, pad.shape[1] // 2, 2, pad.shape[2] // 2, 2), axis=(1, 3, 5))
    if fmt == "zarr":
        about = json.loads((tmp_path / "img" / ".zattrs").read_text())["multiscales"][0]
        assert [d["path"] for d in about["datasets"]] == ["s0", "s1", "s2"]
        assert about["datasets"][2]["coordinateTransformations"][0]["scale"] == [8.0, 2.0, 2.0]
    else:
        about = json.loads((tmp_path / "img" / "attributes.json").read_text())
        assert about["scales"] == [[1] * 3, [2] * 3, [4] * 3]
    N.write_pyramid(table(spark, a[:4], (4, 8, 4)), str(tmp_path), F.lit("img"), 0, fmt, "float64")
    assert C.datasets(str(tmp_path), fmt) == ["img/s0"]  # replaced as a whole
    assert not [f for f in tmp_path.iterdir() if f.name.startswith(".")]


@pytest.mark.parametrize("fmt", ["n5", "zarr"])
def test_write_onto_itself_keeps_every_voxel(spark, tmp_path, fmt):
    a = volume(4, (6, 10, 8))
    root = str(tmp_path)
    C.write(table(spark, a, (3, 5, 4)), root, F.lit("a/s0"), fmt)
    assert C.write(C.read(spark, root, fmt).withColumn("v", F.transform("v", lambda v: v + 1)), root, F.col("folder"), fmt) == 8
    np.testing.assert_array_equal(array(C.read(spark, root, fmt).withColumn("ds", F.lit(0)), a.shape), a + 1)


def test_labels_merged_in_place(spark, tmp_path):
    a = np.zeros((4, 8, 8))
    a[1, 2, :] = 1
    labels = L.segment(table(spark, a, (4, 4, 4)), "threshold", threshold=0.5)
    C.write(labels, str(tmp_path), F.lit("labels"), "n5", "uint32")
    stored = C.read(spark, str(tmp_path), "n5").withColumn("v", F.col("v").cast("array<bigint>"))
    C.write(L.merge(stored, keys=("folder",)), str(tmp_path), F.col("folder"), "n5", "uint32")
    got = array(C.read(spark, str(tmp_path), "n5").withColumn("ds", F.lit(0)), a.shape)
    assert (got == L.connected(a > 0)).all()


def test_a_failing_writer_leaves_the_old_data(spark, tmp_path):
    a = volume(5, (6, 10, 8))
    root = str(tmp_path)
    C.write(table(spark, a, (3, 5, 4)), root, F.lit("a/s0"))
    fails = C.read(spark, root).withColumn("v", F.when((F.col("blk_x") == 1) & (F.col("blk_z") == 1), F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        C.write(fails, root, F.col("folder"))
    np.testing.assert_array_equal(array(C.read(spark, root).withColumn("ds", F.lit(0)), a.shape), a)
    assert not [f for f in tmp_path.iterdir() if f.name.startswith(".")]
