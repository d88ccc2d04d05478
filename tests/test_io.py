"""File formats, slots, listings, named jobs and streams."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_properties import DIMS, array, table, volume
from voxelloom.plans.registry import run_op
from voxelloom.sources import chunked as C
from voxelloom.sources import images as I
from voxelloom.sources import tables as T
from voxelloom.streaming import grouping


@pytest.mark.parametrize("fmt,codec,dtype", [("n5", "raw", "uint8"), ("n5", "gzip", "uint16"), ("n5", "zlib", "float32"),
                                             ("zarr", "raw", "uint16"), ("zarr", "zlib", "int32"), ("zarr", "gzip", "float64")])
def test_container_round_trip(spark, tmp_path, fmt, codec, dtype):
    a = volume()
    n = C.write(table(spark, a, (2, 5, 7)), str(tmp_path), F.lit("a/s0"), fmt, dtype, codec)
    assert n == 3 * 3 * 3
    got = C.read(spark, str(tmp_path), fmt, "a/s0").withColumn("ds", F.lit(0))
    np.testing.assert_array_equal(array(got), a)
    assert C.read(spark, str(tmp_path), fmt, "b/s0").count() == 0


def test_n5_layout_by_hand(spark, tmp_path):
    """A block written by hand from the format's definition, and an absent one."""
    folder = tmp_path / "vol" / "c1" / "s5"
    (folder / "0" / "0").mkdir(parents=True)
    (folder / "attributes.json").write_text(json.dumps(
        {"dimensions": [6, 2, 1], "blockSize": [4, 2, 1], "dataType": "uint16", "compression": {"type": "gzip", "level": -1}}))
    data = np.arange(8, dtype=">u2")
    head = bytes([0, 0, 0, 3, 0, 0, 0, 4, 0, 0, 0, 2, 0, 0, 0, 1])
    (folder / "0" / "0" / "0").write_bytes(head + gzip.compress(data.tobytes()))
    row = C.read(spark, str(tmp_path), "n5").first()
    assert row["folder"] == "vol/c1/s5" and row["dims"] == [1, 2, 6] and row["v"] == list(range(8))
    full = C.densify(C.read(spark, str(tmp_path), "n5")).orderBy("blk_x").collect()
    assert [len(r["v"]) for r in full] == [8, 4] and sum(full[1]["v"]) == 0


@pytest.mark.parametrize("deflate", [False, True])
def test_tiff_pages(spark, tmp_path, deflate):
    pages = [np.arange(12, dtype="uint16").reshape(3, 4) + i for i in range(6)]
    (tmp_path / "x.tif").write_bytes(I.encode_tiff(pages, deflate, '<OME SizeC="2"/>'))
    got = I.read_tiff(spark, str(tmp_path / "*.tif")).orderBy("c", "blk_z").collect()
    assert [(r["c"], r["blk_z"]) for r in got] == [(c, z) for c in range(2) for z in range(3)]
    assert all(np.array_equal(r["v"], p.ravel()) for r, p in zip(got, pages))


def test_nrrd_codec():
    a = (volume() > 50).astype("uint8")
    for codec in ("raw", "gzip"):
        np.testing.assert_array_equal(I.decode_nrrd(I.encode_nrrd(a, codec)), a)


def test_slot_and_listing(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(t, c, t * 10 + c) for t in range(2) for c in range(2)], "t int, c int, v int")
    T.write_slot(df, path)
    T.write_slot(spark.createDataFrame([(0, 0, 99)], "t int, c int, v int"), path)
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 10, 11, 99]
    for name in ("seg-1.tif", "seg-2.tif", "other.tif", "seg.zarr"):
        (tmp_path / name).write_bytes(b"x")
    names = {r["path"].rsplit("/", 1)[-1] for r in T.list_outputs(spark, str(tmp_path), "seg", "tif").collect()}
    assert names == {"seg-1.tif", "seg-2.tif"}


def test_square_affine_files(spark, tmp_path):
    (tmp_path / "affine.mat").write_text("1 0 0 5\n0 1 0 6\n0 0 1 7\n0 0 0 1\n")
    assert T.read_affines(spark, str(tmp_path)).first()["m"] == [1, 0, 0, 5, 0, 1, 0, 6, 0, 0, 1, 7]


def test_stored_result_is_reused(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def compute():
        calls.append(1)
        return spark.range(3)

    assert T.reuse(spark, path, compute).count() == T.reuse(spark, path, compute).count() == 3
    assert len(calls) == 1


def test_jobs_by_name(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 1.0), (0, 1, 1, 1, 3.0)], "ds int, z int, y int, x int, v double")
    assert run_op("pyramid.level", [df]).first()["v"] == 2.0
    with pytest.raises(KeyError):
        run_op("pyramid._halve", [df])


def test_stream_equals_batch_over_many_files(spark, tmp_path):
    """Members arrive in several micro-batches; waiting members survive between them."""
    from voxelloom.operators.manifest import group_fixed

    src = tmp_path / "in"
    rows = [(i % 3 if i % 4 else 0, i) for i in range(200)]
    df = spark.createDataFrame(rows, "user_id bigint, event_id bigint")
    for k in range(5):
        df.where(F.expr(f"event_id div 40 = {k}")).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    got = grouping.run_available(spark, grouping.fixed_groups(stream, "user_id", "event_id", 7), "t").toPandas()
    want = group_fixed(df, "user_id", "event_id", "event_id", 7).toPandas()
    key = lambda d, c: sorted((r["user_id"], r["grp"], tuple(r[c])) for _, r in d.iterrows())
    assert key(got, "members") == key(want, "event_id")
    assert DIMS
