"""What a task reads, holds and hands on does not depend on how many small datasets or blocks there are."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from voxelloom.llm import substring as S
from voxelloom.operators import blocks as B
from voxelloom.operators import labels as L
from voxelloom.plans import fixture_files as FF
from voxelloom.session import configure
from voxelloom.sources import chunked as C
from voxelloom.sources import container as N
from voxelloom.sources import images as I


def frames(df):
    """Rows of each batch that a plan hands to Python."""

    def count(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [len(pdf)]})

    return [r.n for r in df.mapInPandas(count, "n long").collect()]


def volumes(spark, n, bsize=(4, 4, 4), dims=(4, 8, 8)):
    """n volumes with the value ds + 1 in every voxel, in one partition."""
    ids = spark.range(0, n, 1, 1).select(F.col("id").alias("ds"))
    blocks = B.block_skeleton(ids, dims, bsize).withColumns({"dims": B._lit_array(dims), "bsize": B._lit_array(bsize)})
    return blocks.withColumn("v", F.array_repeat((F.col("ds") + 1).cast("double"), 64)).coalesce(1)


def test_small_graphs_are_solved_key_by_key(spark, monkeypatch):
    """More edges in all than SMALL_GRAPH, but no key has more: no rounds.  One key that has more goes by rounds alone."""
    configure(spark)
    df = spark.createDataFrame([(ds, i, i + 1) for ds in (*range(6), None) for i in range(20)], "ds long, a long, b long").repartition(3)
    wanted = {(ds, i, 0) for ds in (*range(6), None) for i in range(21)}
    monkeypatch.setattr(L, "SMALL_GRAPH", 60)
    monkeypatch.setattr(L, "HELD_EDGES", 7)  # runs of edges, cut within keys

    def never():
        raise AssertionError("small graphs took rounds")

    with monkeypatch.context() as m:
        m.setattr(L, "Observation", never)
        assert {tuple(r) for r in L.components(df).collect()} == wanted
    long = spark.createDataFrame([(9, i, i + 1) for i in range(200)], "ds long, a long, b long").repartition(3)
    got = {tuple(r) for r in L.components(df.unionByName(long)).collect()}
    assert got == wanted | {(9, i, 0) for i in range(201)}


def test_rows_of_many_blocks_are_handed_on_together(spark):
    configure(spark)
    one = B.map_block_rows(L.as_parts(volumes(spark, 50)), lambda arrays, row: {"n": np.array([int(arrays[0].sum())])}, "n long")
    assert sum(frames(one)) == 200 and len(frames(one)) == 1
    assert {tuple(r) for r in one.distinct().collect()} == {(i, 64 * (i + 1)) for i in range(50)}
    none = B.map_block_rows(L.as_parts(volumes(spark, 2)), lambda arrays, row: {"n": np.zeros(0, dtype=int)}, "n long")
    assert none.collect() == []


def test_pieces_of_rows_stay_small():
    made = (([i], {"n": np.arange(1000), "patch": [np.zeros(100)] * 1000}) for i in range(40))  # 0.8 MB each
    out = list(B.together(made, ["n", "patch"], ["ds"]))
    assert [len(f) for f in out[:-1]] == [11000] * 3 and sum(map(len, out)) == 40000
    assert list(pd.concat(out)["ds"]) == [i for i in range(40) for _ in range(1000)]


def test_small_datasets_share_a_task(spark, tmp_path):
    """Twelve datasets are read in one task, a long one in several; every block once."""
    configure(spark)
    C.write(volumes(spark, 12), str(tmp_path / "a"), F.concat(F.lit("d"), "ds"), "zarr", "uint16", "raw")
    got = N.read(spark, str(tmp_path / "a"), "zarr")
    assert got.rdd.getNumPartitions() == 1
    assert sorted((r.folder, r.blk_y, r.blk_x, r.v[0]) for r in got.collect()) == sorted(
        (f"d{i}", y, x, i + 1.0) for i in range(12) for y in range(2) for x in range(2))
    about = {"chunk": [64, 128, 128]}  # 8 MB each
    dealt = N.dealt([N.Chunks(f, about, "zyx", [], 0, n) for f, n in (("a", 1), ("b", 20), ("c", 0), ("d", 2))], 1)
    assert [sum(r.last - r.first for r in d.runs) for d in dealt] == [8, 8, 7]
    assert [(r.folder, r.first, r.last) for d in dealt for r in d.runs] == [("a", 0, 1), ("b", 0, 7), ("b", 7, 15), ("b", 15, 20), ("d", 0, 2)]


def test_stacks_are_made_of_blocks(spark, tmp_path):
    configure(spark)
    blocks = volumes(spark, 3).withColumn("c", F.lit(0).cast("long"))
    both = blocks.unionByName(blocks.withColumns({"c": F.lit(1).cast("long"), "v": F.transform("v", lambda v: v * 10)}))
    assert FF.write_tiff(both, str(tmp_path / "t"), F.concat(F.lit("d"), "ds")) == 3 * 2 * 4
    got = {(r.image, r.c, r.blk_z): (tuple(r.dims), set(r.v), len(r.v)) for r in I.read_tiff(spark, f"{tmp_path}/t/*.tif").collect()}
    assert got == {(f"d{i}", c, z): ((4, 8, 8), {(i + 1.0) * (10 if c else 1)}, 64) for i in range(3) for c in (0, 1) for z in range(4)}


def test_marking_holds_little_besides_what_it_sends():
    """3 MB of text: hashed in slices, sorted without a second copy of the columns."""
    text = " ".join(f"w{i * 7919 % 100003:06d}" for i in range(375_000))
    docs = pa.RecordBatch.from_pydict({"text": [text[i:i + 20_000] for i in range(0, len(text), 20_000)]})
    tracemalloc.start()
    seen = sum(len(at) for _, at, _, _ in S._hashed([docs], "text", 13, True))
    hashing = tracemalloc.get_traced_memory()[1]
    rng = np.random.default_rng(0)
    n = 1 << 17
    held = [tuple(rng.integers(0, 1000, n).astype(k) for k in (np.uint64, np.uint64, np.int64, np.int64, np.int64)) for _ in range(4)]
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    S._entries(held, 16)
    entries = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert seen > 300_000 and not held
    assert hashing < 30 << 20 and entries < 60 << 20
