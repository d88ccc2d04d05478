"""Labels joined across blocks by what both blocks segmented."""

import numpy as np
import pytest

from tests.test_properties import array, table
from voxelloom.operators import labels as L
from voxelloom.plans import catalog  # registers the model `bands`


def segmented(spark, a, bsize, overlap):
    return L.segment(table(spark, a, bsize), "bands", overlap, around=True, threshold=0.0, step=10)


def test_touching_instances_cut_by_a_face_stay_two(spark):
    assert catalog.QUERIES
    a = np.zeros((2, 8, 8))
    a[:, 2:6, :4], a[:, 2:6, 4:] = 5, 15  # the face between the blocks lies between the instances
    parts = segmented(spark, a, (2, 8, 4), (0, 0, 2))
    assert len(np.unique(array(L.merge(parts.drop("w")), a.shape))) == 2  # touching at a face joins them
    got = array(L.merge_overlap(parts, (0, 0, 2)), a.shape)
    assert len(np.unique(got)) == 3 and len(np.unique(got[a == 5])) == 1 and len(np.unique(got[a == 15])) == 1


@pytest.mark.parametrize("bsize", [(3, 5, 4), (6, 5, 10), (2, 2, 2)])
def test_instances_across_blocks_become_one(spark, bsize):
    a = np.zeros((6, 10, 10))
    a[1:5, 2:8, 1:9] = 5
    a[1:5, 2:8, 4:6] = 15  # three slabs side by side
    got = array(L.merge_overlap(segmented(spark, a, bsize, (1, 1, 1)), (1, 1, 1)), a.shape)
    assert (got == L.connected(a > 0, labels=a // 10)).all()


def test_shares_decide(spark):
    """Contingency by hand: what two blocks saw of one another, in voxels."""
    a = np.zeros((1, 1, 8))
    a[0, 0, 2:6] = 5
    table_ = L.overlaps(segmented(spark, a, (1, 1, 4), (0, 0, 2)), (0, 0, 2)).first()
    assert (table_.a, table_.b, table_.n, table_.na, table_.nb) == (3, 5, 4, 4, 4)
    assert array(L.merge_overlap(segmented(spark, a, (1, 1, 4), (0, 0, 0)), (0, 0, 0)), a.shape).max() == 5  # nothing seen by both: no link
    for least in (0, 1.5):
        with pytest.raises(ValueError):
            L.merge_overlap(table(spark, a, (1, 1, 4)), (0, 0, 2), least)


def test_large_graphs_take_rounds(spark, monkeypatch):
    rng = np.random.default_rng(1)
    edges = [(0, int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2)) if a != b]
    edges += [(1, i, i + 1) for i in range(120)]
    df = spark.createDataFrame(edges, "ds long, a long, b long").repartition(5)
    small = {tuple(r) for r in L.components(df).collect()}
    monkeypatch.setattr(L, "SMALL_GRAPH", 0)
    assert {tuple(r) for r in L.components(df).collect()} == small
    assert {r for r in small if r[0] == 1} == {(1, i, 0) for i in range(121)}
