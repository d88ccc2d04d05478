"""Plans: tables of whole blocks are shuffled, however small Spark takes them for."""

from __future__ import annotations

import re

import pytest

import __spark_entry__
from voxelloom.operators import fields as D
from voxelloom.operators import warp as W
from voxelloom.plans import fixtures as X

BS = (4, 16, 16)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Two datasets of a few voxels."""
    rows = [(ds * 3000 + i, i * 7 + ds, i * 5, i % 7 + 1, float(i + 1), "1996-01-02", "A") for ds in range(2) for i in range(20)]
    folder = tmp_path_factory.mktemp("plans")
    df = spark.createDataFrame(
        rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate string, l_returnflag string")
    df.selectExpr("* except (l_shipdate)", "to_timestamp(l_shipdate) AS l_shipdate").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def broadcast_sides(df) -> list[str]:
    """The keys of the joins of `df` that broadcast a side."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Broadcast(?:HashJoin \[[^\]]*\]|NestedLoopJoin)", plan)


def test_fields_and_sources_are_not_broadcast(spark, sf):
    field, source = X.disp_blocks(spark, sf, BS), X.mov_blocks(spark, sf, BS)
    assert not broadcast_sides(field)
    assert not broadcast_sides(D.compose(field, field, X.DIMS, BS, affine=None))
    assert not broadcast_sides(W.warp(field, source, X.DIMS, BS, field=D.COMPONENTS, affine=None))


@pytest.mark.parametrize("name", ["compose", "deform", "compose_fields"])
def test_only_small_rows_are_broadcast(spark, sf, name):
    """One row a dataset (an affine) may be broadcast; rows of a block, joined by block ids, never."""
    found = broadcast_sides(__spark_entry__.queries()[name](spark, sf))
    assert not [f for f in found if "blk_" in f or "Nested" in f], found
