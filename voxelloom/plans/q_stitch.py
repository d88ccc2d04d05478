"""Queries: tile stitching."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.operators import blocks as B
from voxelloom.operators import stitch as S
from voxelloom.plans import fixtures as X
from voxelloom.plans.fixtures import sql
from voxelloom.plans.q_select import r6

QUERIES, ORACLES = {}, {}


def _tiles(spark, sf):
    t = X.tiles(spark, sf)
    return t.select("ds", "tile_id", (F.col("oy") + F.col("jy")).alias("y0"), (F.col("ox") + F.col("jx")).alias("x0"), "h", "w")


_T = "SELECT ds, tile_id, oy + jy AS y0, ox + jx AS x0, h, w, jy, jx FROM fx_tiles"
_P = ("SELECT a.ds, a.tile_id AS a_tile_id, b.tile_id AS b_tile_id, a.y0 AS a_y0, a.x0 AS a_x0, a.h AS a_h, a.w AS a_w,"
      " b.y0 AS b_y0, b.x0 AS b_x0, b.h AS b_h, b.w AS b_w, greatest(a.y0, b.y0) AS lo_y, least(a.y0+a.h, b.y0+b.h) AS hi_y,"
      " greatest(a.x0, b.x0) AS lo_x, least(a.x0+a.w, b.x0+b.w) AS hi_x FROM t a JOIN t b ON a.ds = b.ds AND a.tile_id < b.tile_id"
      " AND a.y0 < b.y0+b.h AND b.y0 < a.y0+a.h AND a.x0 < b.x0+b.w AND b.x0 < a.x0+a.w")
QUERIES["tile_overlap_pairs"] = lambda s, d: S.overlap_pairs(_tiles(s, d), (12, 11))
ORACLES["tile_overlap_pairs"] = sql("SELECT * FROM p", t=_T, p=_P)
QUERIES["pair_shift"] = lambda s, d: S.best_shift(
    S.shift_scores(S.overlap_pairs(_tiles(s, d), (12, 11)), X.tile_voxels(s, d), 2))
_SHIFT = dict(
    t=_T, p=_P, s="SELECT CAST(a AS BIGINT) AS sy, CAST(b AS BIGINT) AS sx FROM range(-2, 3) q(a), range(-2, 3) r(b)",
    j="SELECT p.ds, a_tile_id, b_tile_id, sy, sx, u.v AS a, w.v AS b FROM p CROSS JOIN s JOIN fx_tile_voxels u ON u.ds = p.ds AND"
      " u.tile_id = a_tile_id AND u.y + a_y0 >= lo_y AND u.y + a_y0 < hi_y AND u.x + a_x0 >= lo_x AND u.x + a_x0 < hi_x"
      " JOIN fx_tile_voxels w ON w.ds = p.ds AND w.tile_id = b_tile_id AND w.z = u.z AND w.y = u.y + a_y0 + sy - b_y0"
      " AND w.x = u.x + a_x0 + sx - b_x0",
    m="SELECT ds, a_tile_id, b_tile_id, sy, sx, count(*)::DOUBLE AS n, sum(a)::DOUBLE AS sa, sum(b)::DOUBLE AS sb,"
      " sum(a*a)::DOUBLE AS saa, sum(b*b)::DOUBLE AS sbb, sum(a*b)::DOUBLE AS sab FROM j GROUP BY 1, 2, 3, 4, 5",
    c="SELECT *, round((n*sab - sa*sb) / (sqrt(n*saa - sa*sa) * sqrt(n*sbb - sb*sb)), 6) AS r FROM m"
      " WHERE n*saa - sa*sa > 0 AND n*sbb - sb*sb > 0",
    l="SELECT ds, a_tile_id, b_tile_id, sy, sx, r, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY ds,"
      " a_tile_id, b_tile_id ORDER BY r DESC, abs(sy) + abs(sx), sy, sx) AS k FROM c) WHERE k = 1",
)
ORACLES["pair_shift"] = sql("SELECT * FROM l", **_SHIFT)
QUERIES["link_filter"] = lambda s, d: S.filter_links(QUERIES["pair_shift"](s, d), 0.9)
ORACLES["link_filter"] = sql("SELECT * FROM l WHERE r >= 0.9", **_SHIFT)


def _links(spark, sf):
    """Links as the stage errors imply them."""
    t = X.tiles(spark, sf).select("ds", "tile_id", "jy", "jx")
    p = S.overlap_pairs(_tiles(spark, sf), (12, 11)).select("ds", "a_tile_id", "b_tile_id")
    for side in "ab":
        p = p.join(t.select("ds", F.col("tile_id").alias(f"{side}_tile_id"), F.col("jy").alias(f"{side}y"), F.col("jx").alias(f"{side}x")),
                   ["ds", f"{side}_tile_id"])
    return p.select("ds", "a_tile_id", "b_tile_id", (F.col("by") - F.col("ay")).alias("sy"), (F.col("bx") - F.col("ax")).alias("sx"))


def tile_solve(spark, sf):
    """Corrections from consistent links: the stage errors, relative to tile 0."""
    p = S.place(_tiles(spark, sf), _links(spark, sf))
    return p.select("ds", "tile_id", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("dy", "dx")])


QUERIES["tile_solve"] = tile_solve
ORACLES["tile_solve"] = sql(
    "SELECT t.ds, t.tile_id, (o.jy - t.jy)::DOUBLE + 0e0 AS dy, (o.jx - t.jx)::DOUBLE + 0e0 AS dx FROM fx_tiles t JOIN fx_tiles o"
    " ON o.ds = t.ds AND o.tile_id = 0")
QUERIES["fuse_tiles"] = lambda s, d: S.fuse(X.tile_voxels(s, d), _tiles(s, d)).withColumn("v", r6("v"))
_FW = "least(y + 1, h - y) * least(x + 1, w - x)"
ORACLES["fuse_tiles"] = sql(
    f"SELECT ds, z, y + y0 AS y, x + x0 AS x, round(sum({_FW} * v) / sum({_FW}), 6) + 0e0 AS v FROM fx_tile_voxels"
    " JOIN t USING (ds, tile_id) GROUP BY 1, 2, 3, 4", t=_T)


_REACH, _LEAST = (1, 2, 2), 12


def pair_shift_volume(spark, sf):
    """Shifts in z, y and x of tiles whose stage is also off by one in z, from sums of all shifts by Fourier transforms."""
    t = _tiles(spark, sf).select("ds", "tile_id", (F.col("tile_id") % 2).alias("z0"), "y0", "x0", F.lit(7).cast("bigint").alias("d"), "h", "w")
    vox = X.tile_voxels(spark, sf).select("ds", "tile_id", "z", "y", "x", "v")
    blocks = B.pack(vox, (7, 12, 11), (4, 6, 6), keys=("ds", "tile_id"))
    scores = S.shift_volumes(S.overlap_boxes(t, (8, 12, 11)), blocks, (4, 6, 6), _REACH, (4, 5, 6))
    return S.best_shift_volume(scores, _LEAST).withColumn("r", F.round("r", 4))


QUERIES["pair_shift_volume"] = pair_shift_volume
_V = {
    "t": "SELECT ds, tile_id, tile_id % 2 AS z0, oy + jy AS y0, ox + jx AS x0, 7 AS d, h, w FROM fx_tiles",
    "p": "SELECT a.ds, a.tile_id AS a_tile_id, b.tile_id AS b_tile_id, " + ", ".join(
        f"a.{c}0 AS a_{c}0, b.{c}0 AS b_{c}0, greatest(a.{c}0, b.{c}0) AS lo_{c}, least(a.{c}0 + a.{n}, b.{c}0 + b.{n}) AS hi_{c}" for c, n in zip("zyx", "dhw"))
        + " FROM t a JOIN t b ON a.ds = b.ds AND a.tile_id < b.tile_id AND " + " AND ".join(
            f"a.{c}0 < b.{c}0 + b.{n} AND b.{c}0 < a.{c}0 + a.{n}" for c, n in zip("zyx", "dhw")),
    "s": "SELECT CAST(a AS BIGINT) AS sz, CAST(b AS BIGINT) AS sy, CAST(c AS BIGINT) AS sx FROM range(-1, 2) o(a), range(-2, 3) q(b), range(-2, 3) r(c)",
    # tiles that reach over the volume's border hold zeros there
    "g": "SELECT t.ds, t.tile_id, CAST(a AS BIGINT) AS z, CAST(b AS BIGINT) AS y, CAST(c AS BIGINT) AS x FROM t, range(7) o(a), range(12) q(b), range(11) r(c)",
    "u": "SELECT g.*, coalesce(f.v, 0) AS v FROM g LEFT JOIN fx_tile_voxels f USING (ds, tile_id, z, y, x)",
    "j": "SELECT p.ds, a_tile_id, b_tile_id, sz, sy, sx, m.v AS a, w.v AS b FROM p JOIN u m ON m.ds = p.ds AND m.tile_id = a_tile_id AND "
         + " AND ".join(f"m.{c} + a_{c}0 >= lo_{c} AND m.{c} + a_{c}0 < hi_{c}" for c in "zyx")
         + " CROSS JOIN s JOIN u w ON w.ds = p.ds AND w.tile_id = b_tile_id AND " + " AND ".join(f"w.{c} = m.{c} + a_{c}0 + s{c} - b_{c}0" for c in "zyx"),
    "m": "SELECT ds, a_tile_id, b_tile_id, sz, sy, sx, count(*)::DOUBLE AS n, sum(a)::DOUBLE AS sa, sum(b)::DOUBLE AS sb, sum(a*a)::DOUBLE AS saa,"
         " sum(b*b)::DOUBLE AS sbb, sum(a*b)::DOUBLE AS sab FROM j GROUP BY ALL",
    "c": "SELECT *, round((n*sab - sa*sb) / (sqrt(n*saa - sa*sa) * sqrt(n*sbb - sb*sb)), 5) AS r FROM m"
         f" WHERE n*saa - sa*sa > 0 AND n*sbb - sb*sb > 0 AND n >= {_LEAST}",
}
ORACLES["pair_shift_volume"] = sql(
    "SELECT ds, a_tile_id, b_tile_id, sz, sy, sx, round(r, 4) AS r, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY ds, a_tile_id,"
    " b_tile_id ORDER BY r DESC, abs(sz) + abs(sy) + abs(sx), sz, sy, sx) AS k FROM c) WHERE k = 1", **_V)
