"""What a Python worker holds is bounded by bytes, not by how many blocks its partition has."""

from __future__ import annotations

import glob

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from voxelloom.operators import blocks as B
from voxelloom.session import configure
from voxelloom.sources import tables as T


def test_pieces_cover_all_rows_in_order_and_stay_small():
    rows = 5000
    pdf = pd.DataFrame({"i": range(rows), "bsize": [np.array([4, 16, 16])] * rows})
    out = list(B.pieces([pdf, pdf[:0]], B.block_bytes(3)))
    assert list(pd.concat(out)["i"]) == list(range(rows))
    assert max(len(p) for p in out) * 3 * 8 * 1024 <= B.PIECE_BYTES
    huge = pd.DataFrame({"i": [0, 1], "bsize": [np.array([256, 256, 256])] * 2})
    assert [len(p) for p in B.pieces([huge], B.block_bytes())] == [1, 1]


def test_empty_blocks_are_handed_on_in_pieces(spark):
    """4096 empty blocks of 32 KB in one partition: 128 MB in all."""
    configure(spark)
    ids = spark.range(0, 64, 1, 1).select(F.col("id").alias("ds"))
    none = ids.where("ds < 0").select("ds", *[F.lit(0).cast("bigint").alias(c) for c in "zyxv"])

    def lengths(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [len(pdf)], "bytes": [sum(v.nbytes for v in pdf["v"])]})

    got = B.pack(none, (64, 64, 64), (16, 16, 16), ids=ids).coalesce(1).mapInPandas(lengths, "n long, bytes long").toPandas()
    assert got["n"].sum() == 4096 and got["bytes"].sum() == 4096 * 32768
    assert got["bytes"].max() <= 2 * B.PIECE_BYTES


def test_points_of_a_key_are_written_once(spark, tmp_path):
    points = spark.range(0, 400, 1, 8).select((F.col("id") % 20).alias("ds"), F.col("id").alias("point_id"), F.lit(0).cast("long").alias("c"),
                                              *[F.col("id").cast("double").alias(a) for a in ("z", "y", "x", "intensity")])
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")  # several partitions
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    try:
        T.write_points(points, str(tmp_path / "p"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert len(glob.glob(f"{tmp_path}/p/ds=*/*.csv")) == 20
    assert sorted(map(tuple, T.read_points(spark, str(tmp_path / "p")).select("ds", "point_id").collect())) == sorted((i % 20, i) for i in range(400))
