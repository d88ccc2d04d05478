"""Queries: segmentation and labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from voxelloom.operators import blocks as B
from voxelloom.operators import labels as L
from voxelloom.operators import pyramid as P
from voxelloom.operators import stats as T
from voxelloom.plans import fixtures as X
from voxelloom.plans.fixtures import sql

QUERIES, ORACLES = {}, {}
BS = (4, 8, 8)


def _threshold(spark, sf):
    return T.quantiles(X.fix(spark, sf), [0.8]).withColumnRenamed("q0", "threshold")


def _segmented(spark, sf, **kw):
    return L.segment(X.fix_blocks(spark, sf, BS), "threshold", per_key=_threshold(spark, sf), **kw)


def _labels(blocks):
    return B.unpack(blocks).withColumnRenamed("v", "label").where("label <> 0")


_FG = ("SELECT ds, z, y, x, (z * 32 + y) * 32 + x + 1 AS id FROM fx_fix JOIN"
       " (SELECT ds, quantile_cont(v, 0.8) AS q FROM fx_fix GROUP BY ds) USING (ds) WHERE v > q")


def components_sql(body, fg=_FG, extra="", planes=False):
    """Components of the voxels in fg (ds, z, y, x, id): lab (ds, z, y, x, label)."""
    off = "(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)" + ("" if planes else ",(1,0,0),(-1,0,0)")
    return sql(
        body, fg=fg,
        e="SELECT a.ds, a.id AS a, b.id AS b FROM fg a CROSS JOIN (VALUES " + off + ") o(oz, oy, ox) JOIN fg b ON"
          " b.ds = a.ds AND b.z = a.z + oz AND b.y = a.y + oy AND b.x = a.x + ox" + extra,
        r="SELECT ds, id AS a, id AS b FROM fg UNION SELECT r.ds, r.a, e.b FROM r JOIN e ON e.ds = r.ds AND e.a = r.b",
        lab="SELECT fg.ds, z, y, x, min(r.b) AS label FROM r JOIN fg ON r.ds = fg.ds AND r.a = fg.id GROUP BY 1, 2, 3, 4",
    )


_SAME_BLOCK = " AND a.z // 4 = b.z // 4 AND a.y // 8 = b.y // 8 AND a.x // 8 = b.x // 8"
QUERIES["segment_blocks"] = lambda s, d: _labels(_segmented(s, d))
ORACLES["segment_blocks"] = components_sql("SELECT * FROM lab", extra=_SAME_BLOCK)


def label_ids(spark, sf):
    """Each temporary label with its block and size; no label occurs in two blocks."""
    return L.label_places(_segmented(spark, sf))


QUERIES["label_ids"] = label_ids
ORACLES["label_ids"] = components_sql(
    "SELECT ds, z // 4 AS blk_z, y // 8 AS blk_y, x // 8 AS blk_x, label, count(*) AS n FROM lab GROUP BY 1, 2, 3, 4, 5",
    extra=_SAME_BLOCK)
QUERIES["merge_labels"] = lambda s, d: _labels(L.merge(_segmented(s, d, overlap=(1, 2, 2))))
ORACLES["merge_labels"] = components_sql("SELECT * FROM lab")


def merge_labels_masked(spark, sf):
    mask = B.pack(X.mask(spark, sf), X.DIMS, BS, cols=("m",), ids=X.datasets(spark, sf))
    return _labels(L.merge(_segmented(spark, sf), mask=mask))


_CUT = " AND (y-16)*(y-16)+(x-16)*(x-16) <= 144"
QUERIES["merge_labels_masked"] = merge_labels_masked
ORACLES["merge_labels_masked"] = components_sql("SELECT * FROM lab", fg=_FG + _CUT)


@L.model("bands")
def bands_model(a, params):
    """Instances that may touch: components of voxels above `threshold` in one band of `step` values."""
    return L.connected(a > params["threshold"], labels=a // params["step"])


_OV, _STEP = (1, 2, 2), 64


def merge_overlap(spark, sf):
    """Touching instances, joined across blocks by what both blocks segmented."""
    return _labels(L.merge_overlap(_segmented_bands(spark, sf), _OV, 0.5))


def _segmented_bands(spark, sf):
    return L.segment(X.fix_blocks(spark, sf, BS), "bands", _OV, per_key=_threshold(spark, sf), around=True, step=_STEP)


_NEAR = "(VALUES (-1), (0), (1)) {}({})"
QUERIES["merge_overlap"] = merge_overlap
ORACLES["merge_overlap"] = sql(
    # every object has the smallest label that it reaches bj links
    "SELECT l.ds, z, y, x, coalesce(m, label) AS label FROM core l LEFT JOIN (SELECT ds, a, min(b) AS m FROM reached GROUP BY ds, a) r"
    " ON r.ds = l.ds AND r.a = l.label",
    fg=f"SELECT ds, z, y, x, (z * 32 + y) * 32 + x + 1 AS id, v // {_STEP} AS band FROM fx_fix JOIN"
       " (SELECT ds, quantile_cont(v, 0.8) AS q FROM fx_fix GROUP BY ds) USING (ds) WHERE v > q",
    # voxels of every block with its overlap
    ext="SELECT ds, z, y, x, id, band, z // 4 + a AS bk, y // 8 + b AS bj, x // 8 + c AS bi FROM fg, " + ", ".join(_NEAR.format(*p) for p in ("pa", "qb", "rc"))
        + " WHERE z // 4 + a BETWEEN 0 AND 1 AND y // 8 + b BETWEEN 0 AND 3 AND x // 8 + c BETWEEN 0 AND 3"
          f" AND z BETWEEN (z // 4 + a) * 4 - {_OV[0]} AND (z // 4 + a) * 4 + 3 + {_OV[0]}"
          f" AND y BETWEEN (y // 8 + b) * 8 - {_OV[1]} AND (y // 8 + b) * 8 + 7 + {_OV[1]}"
          f" AND x BETWEEN (x // 8 + c) * 8 - {_OV[2]} AND (x // 8 + c) * 8 + 7 + {_OV[2]}",
    e="SELECT p.ds, p.bk, p.bj, p.bi, p.id AS a, q.id AS b FROM ext p CROSS JOIN (VALUES (0,1,0),(0,-1,0),(0,0,1),(0,0,-1),(1,0,0),(-1,0,0)) o(oz, oy, ox)"
      " JOIN ext q ON q.ds = p.ds AND q.bk = p.bk AND q.bj = p.bj AND q.bi = p.bi AND q.z = p.z + oz AND q.y = p.y + oy AND q.x = p.x + ox AND q.band = p.band",
    r="SELECT ds, bk, bj, bi, id AS a, id AS b FROM ext UNION SELECT r.ds, r.bk, r.bj, r.bi, r.a, e.b FROM r JOIN e"
      " ON e.ds = r.ds AND e.bk = r.bk AND e.bj = r.bj AND e.bi = r.bi AND e.a = r.b",
    # the label of a voxel in a block: the smallest voxel of its object in the block's core
    lab="SELECT ds, bk, bj, bi, a AS id, min(b) AS label FROM r WHERE (b - 1) // 1024 // 4 = bk AND (b - 1) // 32 % 32 // 8 = bj AND (b - 1) % 32 // 8 = bi"
        " GROUP BY 1, 2, 3, 4, 5",
    seen="SELECT l.*, z, y, x, z // 4 = bk AND y // 8 = bj AND x // 8 = bi AS own FROM lab l JOIN fg USING (ds, id)",
    core="SELECT ds, z, y, x, label, id FROM seen WHERE own",
    # all voxels that two blocks segmented, in the core of one of them
    region="SELECT p.ds, p.id, p.bk, p.bj, p.bi, q.bk AS ck, q.bj AS cj, q.bi AS ci FROM ext p JOIN ext q ON p.ds = q.ds AND p.id = q.id"
           " AND (p.bk, p.bj, p.bi) < (q.bk, q.bj, q.bi)"
           " WHERE p.z // 4 = p.bk AND p.y // 8 = p.bj AND p.x // 8 = p.bi OR q.z // 4 = q.bk AND q.y // 8 = q.bj AND q.x // 8 = q.bi",
    met="SELECT g.*, s.label AS a, t.label AS b FROM region g LEFT JOIN lab s ON s.ds = g.ds AND s.id = g.id AND s.bk = g.bk AND s.bj = g.bj AND s.bi = g.bi"
        " LEFT JOIN lab t ON t.ds = g.ds AND t.id = g.id AND t.bk = g.ck AND t.bj = g.cj AND t.bi = g.ci",
    n="SELECT ds, bk, bj, bi, ck, cj, ci, a, b, count(*) AS n FROM met WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL",
    na="SELECT ds, bk, bj, bi, ck, cj, ci, a, count(*) AS na FROM met WHERE a IS NOT NULL GROUP BY ALL",
    nb="SELECT ds, bk, bj, bi, ck, cj, ci, b, count(*) AS nb FROM met WHERE b IS NOT NULL GROUP BY ALL",
    links="SELECT ds, a, b FROM n JOIN na USING (ds, bk, bj, bi, ck, cj, ci, a) JOIN nb USING (ds, bk, bj, bi, ck, cj, ci, b) WHERE 2 * n >= na + nb - n",
    sides="SELECT ds, a, b FROM links UNION SELECT ds, b, a FROM links",
    reached="SELECT ds, a, a AS b FROM sides UNION SELECT r.ds, r.a, o.b FROM reached r JOIN sides o ON o.ds = r.ds AND o.a = r.b",
)
QUERIES["seg_2d"] = lambda s, d: _labels(L.merge(_segmented(s, d, in_plane=True), in_plane=True))
ORACLES["seg_2d"] = components_sql("SELECT * FROM lab", planes=True)
QUERIES["min_size"] = lambda s, d: _labels(L.drop_small(L.merge(_segmented(s, d)), 3))
ORACLES["min_size"] = components_sql(
    "SELECT l.* FROM lab l JOIN (SELECT ds, label FROM lab GROUP BY 1, 2 HAVING count(*) >= 3) USING (ds, label)")
QUERIES["relabel_seq"] = lambda s, d: _labels(L.relabel_sequential(L.merge(_segmented(s, d))))
ORACLES["relabel_seq"] = components_sql(
    "SELECT ds, z, y, x, dense_rank() OVER (PARTITION BY ds ORDER BY label) AS label FROM lab")


def diameter_scale(spark, sf):
    """Objects of diameter 20 for a model of diameter 10: run at half the in-plane resolution."""
    f = L.diameter_factor(20.0, 10.0)
    coarse = P.level(X.fix(spark, sf), (1, f, f))
    dims = P.level_dims(X.DIMS, (1, f, f))
    q = T.quantiles(coarse, [0.8]).withColumnRenamed("q0", "threshold")
    blocks = B.pack(coarse, dims, BS, ids=X.datasets(spark, sf))
    labels = _labels(L.merge(L.segment(blocks, "threshold", per_key=q)))
    return L.upsample_labels(labels, (1, f, f), X.DIMS)


QUERIES["diameter_scale"] = diameter_scale
ORACLES["diameter_scale"] = components_sql(
    "SELECT ds, z, CAST(y * 2 + a AS BIGINT) AS y, CAST(x * 2 + b AS BIGINT) AS x, label FROM lab, range(2) p(a), range(2) q(b)",
    fg="SELECT ds, z, y, x, (z * 16 + y) * 16 + x + 1 AS id FROM (SELECT ds, z, y // 2 AS y, x // 2 AS x, avg(v) AS v"
       " FROM fx_fix GROUP BY 1, 2, 3, 4) JOIN (SELECT ds, quantile_cont(v, 0.8) AS q FROM (SELECT ds, avg(v) AS v"
       " FROM fx_fix GROUP BY ds, z, y // 2, x // 2) GROUP BY ds) USING (ds) WHERE v > q")


@L.model("rows")
def rows_model(a, params):
    """Example of a user kernel: voxels at least `level`, one label per line along x."""
    on = a >= params["level"]
    line = np.arange(a.shape[0] * a.shape[1]).reshape(a.shape[0], a.shape[1], 1) + 1
    return np.where(on, line, 0)


QUERIES["udf_block"] = lambda s, d: _labels(L.segment(X.fix_blocks(s, d, BS), "rows", level=30))
ORACLES["udf_block"] = sql(
    "SELECT ds, z, y, x, min((z * 32 + y) * 32 + x + 1) OVER (PARTITION BY ds, z, y, x // 8) AS label FROM fx_fix WHERE v >= 30")
