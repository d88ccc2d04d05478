"""Queries: global and local registration."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from voxelloom.functions import affine as A
from voxelloom.operators import blocks as B
from voxelloom.operators import fields as D
from voxelloom.operators import filters as N
from voxelloom.operators import local as LO
from voxelloom.operators import register as R
from voxelloom.operators import spots as P
from voxelloom.operators import warp as W
from voxelloom.plans import fixtures as X
from voxelloom.plans import registration as G
from voxelloom.plans.fixtures import sql
from voxelloom.plans.q_filters import _NEAR, _PEAK
from voxelloom.plans.q_select import r6
from voxelloom.session import cut

QUERIES, ORACLES = {}, {}
BS = (7, 16, 16)
#: Guards and context for volumes of 32 voxels a side.
SMALL = {"cc_radius": 1, "point_matches_threshold": 8, "fix_spots_count_threshold": 8, "mov_spots_count_threshold": 8}
FT, MT = 75.0, 151.0  # spot thresholds; the moving intensities are 2v + 1


def _fix_spots(s, d):
    return R.contexts(X.fix_blocks(s, d, BS), 1, FT)


def _mov_spots(s, d):
    return R.contexts(X.mov_blocks(s, d, BS), 1, MT)


def _matches(s, d):
    return R.match(cut(_fix_spots(s, d)), cut(_mov_spots(s, d)), 4.0, 0.6)


_SPOT = dict(
    pf=_PEAK, ff=f"SELECT * FROM pf WHERE v >= {FT}", pm=_PEAK.replace("fx_fix", "fx_mov"), mm=f"SELECT * FROM pm WHERE v >= {MT}",
    pair="SELECT f.ds, f.z AS fz, f.y AS fy, f.x AS fx, m.z AS mz, m.y AS my, m.x AS mx, CAST((f.z-m.z)*(f.z-m.z) +"
         " (f.y-m.y)*(f.y-m.y) + (f.x-m.x)*(f.x-m.x) AS DOUBLE) AS dist2 FROM ff f JOIN mm m ON f.ds = m.ds"
         " WHERE (f.z-m.z)*(f.z-m.z) + (f.y-m.y)*(f.y-m.y) + (f.x-m.x)*(f.x-m.x) <= 16",
)
_C27 = "SELECT * FROM range(-1, 2) a(oz), range(-1, 2) b(oy), range(-1, 2) c(ox)"


def _patch(src, t):
    """Context cubes in SQL: positions first, then an equi-join."""
    at = ", ".join(f"CAST(least(greatest({a} + o{a}, 0), {n - 1}) AS BIGINT) AS g{a}" for a, n in zip("zyx", X.DIMS))
    return (f"SELECT s.ds, s.z, s.y, s.x, oz, oy, ox, g.v FROM (SELECT *, {at} FROM {src}, c27) s JOIN {t} g"
            " ON g.ds = s.ds AND g.z = s.gz AND g.y = s.gy AND g.x = s.gx")


_MATCH = dict(
    **_SPOT, c27=_C27, cf=_patch("(SELECT * EXCLUDE v FROM ff)", "fx_fix"), cm=_patch("(SELECT * EXCLUDE v FROM mm)", "fx_mov"),
    sums="SELECT p.ds, fz, fy, fx, mz, my, mx, dist2, count(*)::DOUBLE AS n, sum(a.v)::DOUBLE AS sa, sum(b.v)::DOUBLE AS sb,"
         " sum(a.v*a.v)::DOUBLE AS saa, sum(b.v*b.v)::DOUBLE AS sbb, sum(a.v*b.v)::DOUBLE AS sab FROM pair p JOIN"
         " (SELECT ds, z AS fz, y AS fy, x AS fx, oz, oy, ox, v FROM cf) a USING (ds, fz, fy, fx) JOIN (SELECT ds, z AS mz,"
         " y AS my, x AS mx, oz, oy, ox, v FROM cm) b USING (ds, mz, my, mx, oz, oy, ox) GROUP BY ALL",
    sc="SELECT *, round((n*sab - sa*sb) / (sqrt(n*saa - sa*sa) * sqrt(n*sbb - sb*sb)), 6) AS r FROM sums"
       " WHERE n*saa - sa*sa > 0 AND n*sbb - sb*sb > 0",
    mt="SELECT ds, fz, fy, fx, mz, my, mx, r, dist2 FROM (SELECT *, row_number() OVER (PARTITION BY ds, fz, fy, fx"
       " ORDER BY r DESC, mz, my, mx) AS k FROM sc WHERE r >= 0.6) WHERE k = 1",
)
QUERIES["spot_guard"] = lambda s, d: (
    P.enough(N.local_max(X.fix_blocks(s, d, BS), FT), 20).withColumn("side", F.lit("fix"))
    .unionByName(P.enough(N.local_max(X.mov_blocks(s, d, BS), MT), 20).withColumn("side", F.lit("mov"))))
ORACLES["spot_guard"] = sql(
    "SELECT ds, count(*) AS n, 'fix' AS side FROM ff GROUP BY ds HAVING count(*) >= 20 UNION ALL"
    " SELECT ds, count(*), 'mov' FROM mm GROUP BY ds HAVING count(*) >= 20", **_SPOT)
QUERIES["match_distance"] = lambda s, d: R.near_pairs(
    N.local_max(X.fix_blocks(s, d, BS), FT), N.local_max(X.mov_blocks(s, d, BS), MT),
    R.distance_limit(X.DIMS, 4.0, 0.25))
ORACLES["match_distance"] = sql("SELECT * FROM pair", **_SPOT)
QUERIES["spot_match"] = _matches
ORACLES["spot_match"] = sql("SELECT * FROM mt", **_MATCH)
QUERIES["match_guard"] = lambda s, d: P.enough(_matches(s, d), 20)
ORACLES["match_guard"] = sql("SELECT ds, count(*) AS n FROM mt GROUP BY ds HAVING count(*) >= 20", **_MATCH)
QUERIES["ransac_translation"] = lambda s, d: R.consensus_shift(_matches(s, d), 1.0)
ORACLES["ransac_translation"] = sql(
    "SELECT ds, sz, sy, sx, inliers FROM (SELECT *, row_number() OVER (PARTITION BY ds ORDER BY inliers DESC,"
    " sz*sz+sy*sy+sx*sx, sz, sy, sx) AS k FROM h) WHERE k = 1", **_MATCH,
    t="SELECT ds, mz - fz AS sz, my - fy AS sy, mx - fx AS sx FROM mt",
    h="SELECT u.ds, u.sz, u.sy, u.sx, count(*) AS inliers FROM (SELECT DISTINCT * FROM t) u JOIN t ON t.ds = u.ds AND"
      " (t.sz-u.sz)*(t.sz-u.sz) + (t.sy-u.sy)*(t.sy-u.sy) + (t.sx-u.sx)*(t.sx-u.sx) <= 1 GROUP BY 1, 2, 3, 4")


def ransac_affine(spark, sf):
    """Consensus of the spot matches; the moving volume is an exact shift by (0, 1, 2)."""
    out = R.ransac(cut(_matches(spark, sf)), 0.9)
    return out.select("ds", "inliers", *A.columns(F.col("m"), 4))


QUERIES["ransac_affine"] = ransac_affine
ORACLES["ransac_affine"] = sql(
    "SELECT ds, count(*) AS inliers, 1e0 AS m00, 0e0 AS m01, 0e0 AS m02, 0e0 AS m03, 0e0 AS m10, 1e0 AS m11, 0e0 AS m12, 1e0 AS m13,"
    " 0e0 AS m20, 0e0 AS m21, 1e0 AS m22, 2e0 AS m23 FROM mt WHERE mz = fz AND my = fy + 1 AND mx = fx + 2 GROUP BY ds", **_MATCH)


def _pairs_of_points(spark, sf):
    """Points and where the first affine of their dataset takes them."""
    m = X.affines(spark, sf).where("seq = 2").drop("seq")
    p = X.points(spark, sf).join(m, "ds")
    return p.select("ds", *[F.col(a).alias(f"f{a}") for a in "zyx"],
                    *[e.alias(f"m{a}") for e, a in zip(A.apply(F.col("m"), [F.col(a) for a in "zyx"]), "zyx")])


def affine_lsq(spark, sf):
    """Normal-equation row and solution; the solution must be the generating affine."""
    pairs = _pairs_of_points(spark, sf)
    sums = R.normal_sums(pairs)
    return sums.join(R.solve_normal(sums), "ds").select("ds", *[r6(c).alias(c) for c in R.NORMAL], *A.columns(F.col("m"), 5))


QUERIES["affine_lsq"] = affine_lsq
_Q = {a: f"(m.m{i}0*p.z + m.m{i}1*p.y + m.m{i}2*p.x + m.m{i}3)" for i, a in enumerate("zyx")}
ORACLES["affine_lsq"] = sql(
    "SELECT p.ds, count(*)::DOUBLE AS n, " + ", ".join(
        [f"round(sum(p.{a}), 6) AS s_{a}" for a in "zyx"]
        + [f"round(sum(p.{a}*p.{b}), 6) AS s_{a}{b}" for i, a in enumerate("zyx") for b in "zyx"[i:]]
        + [f"round(sum({_Q[t]}{'' if a == '1' else '*p.' + a}), 6) + 0e0 AS t{t}_{a}" for t in "zyx" for a in "zyx1"]
        + [f"any_value(m{i}{j}) + 0e0 AS m{i}{j}" for i in range(3) for j in range(4)])
    + " FROM fx_points p JOIN fx_affine m ON m.ds = p.ds AND m.seq = 2 GROUP BY p.ds")
QUERIES["affine_center"] = lambda s, d: R.centres(X.fix(s, d), X.mov(s, d)).select("ds", *A.columns(F.col("m")))
ORACLES["affine_center"] = sql(
    "SELECT ds, 1e0 AS m00, 0e0 AS m01, 0e0 AS m02, round(m.z - f.z, 6) + 0e0 AS m03, 0e0 AS m10, 1e0 AS m11, 0e0 AS m12,"
    " round(m.y - f.y, 6) + 0e0 AS m13, 0e0 AS m20, 0e0 AS m21, 1e0 AS m22, round(m.x - f.x, 6) + 0e0 AS m23"
    " FROM f JOIN m USING (ds)",
    f="SELECT ds, sum(v*z)/sum(v)::DOUBLE AS z, sum(v*y)/sum(v)::DOUBLE AS y, sum(v*x)/sum(v)::DOUBLE AS x FROM fx_fix GROUP BY ds",
    m="SELECT ds, sum(v*z)/sum(v)::DOUBLE AS z, sum(v*y)/sum(v)::DOUBLE AS y, sum(v*x)/sum(v)::DOUBLE AS x FROM fx_mov GROUP BY ds")


def affine_refine(spark, sf):
    """Refinement on smoothed volumes from a start that is half a voxel off in x."""
    fix = N.smooth(X.fix_blocks(spark, sf, BS), (1.0, 1.0, 1.0))
    start = X.datasets(spark, sf).select("ds", A.translation(F.lit(0.0), F.lit(0.25), F.lit(0.5)).alias("m"))
    out = R.refine_affine(fix, fix, start, X.DIMS, BS, margin=(1, 2, 2))
    return out.select("ds", (F.col("error") < F.col("first_error")).alias("improved"), *A.columns(F.col("m"), 1))


QUERIES["affine_refine"] = affine_refine


def align_steps(spark, sf):
    """Steps 'ransac,affine' folded; recovers the shift (0, 1, 2)."""
    cfg = {"ransac": {"threshold": FT, "max_spot_match_distance": 4.0, **SMALL}}
    m = G.global_align(X.fix_blocks(spark, sf, BS), X.mov_blocks(spark, sf, BS), X.DIMS, BS, "ransac,affine", cfg)
    return m.select("ds", *A.columns(F.col("m"), 1))


QUERIES["align_steps"] = align_steps
_KNOWN = ("SELECT DISTINCT ds, {}1e0 AS m00, 0e0 AS m01, 0e0 AS m02, 0e0 AS m03, 0e0 AS m10, 1e0 AS m11, 0e0 AS m12, {}e0 AS m13,"
          " 0e0 AS m20, 0e0 AS m21, 1e0 AS m22, {}e0 AS m23 FROM fx_fix")
ORACLES["align_steps"] = sql(_KNOWN.format("", 1, 2))
ORACLES["affine_refine"] = sql(_KNOWN.format("true AS improved, ", 0, 0))


def _unscaled(spark, sf, bsize):
    b = X.mov_blocks(spark, sf, bsize)
    return b.withColumn("v", F.transform("v", lambda t: (t - 1) / 2))


QUERIES["local_shift"] = lambda s, d: LO.block_shifts(X.fix_blocks(s, d, (7, 8, 8)), _unscaled(s, d, (7, 8, 8)), (0, 2, 2)).withColumn(
    "score", F.round("score", 6))
ORACLES["local_shift"] = sql(
    "SELECT ds, blk_z, blk_y, blk_x, dz, dy, dx, round(score, 6) AS score, n FROM (SELECT *, row_number() OVER (PARTITION BY ds, blk_z,"
    " blk_y, blk_x ORDER BY score, abs(dy) + abs(dx), dy, dx) AS k FROM c) WHERE k = 1",
    s="SELECT CAST(a AS BIGINT) AS dy, CAST(b AS BIGINT) AS dx FROM range(-2, 3) q(a), range(-2, 3) r(b)",
    c="SELECT f.ds, f.z // 7 AS blk_z, f.y // 8 AS blk_y, f.x // 8 AS blk_x, CAST(0 AS BIGINT) AS dz, dy, dx,"
      " sum((f.v - (m.v - 1) / 2e0) * (f.v - (m.v - 1) / 2e0)) / count(*) AS score, count(*) AS n FROM fx_fix f CROSS JOIN s"
      " JOIN fx_mov m ON m.ds = f.ds AND m.z = f.z AND m.y = f.y + dy AND m.x = f.x + dx GROUP BY 1, 2, 3, 4, 5, 6, 7")


def local_align(spark, sf):
    """Field of the block-wise alignment after the identity; the truth is (0, 1, 2)."""
    bs = (7, 16, 16)
    start = X.datasets(spark, sf).select("ds", A.identity().alias("m"))
    out = LO.align(cut(X.fix_blocks(spark, sf, bs)), cut(X.mov_blocks(spark, sf, bs)), start, X.DIMS, bs, overlap=(0, 2, 2))
    return B.unpack(out["field"], D.COMPONENTS).select("ds", "z", "y", "x", *[r6(c).alias(c) for c in D.COMPONENTS])


QUERIES["local_align"] = local_align
# The moving volume is an exact shift: every block that is not flat must find it.
_T16 = "least(greatest(least({a} - (c{a}*16 - 2) + 0.5e0, (c{a}+1)*16 + 2 - {a} - 0.5e0) / 4e0, 0e0), 1e0)"
ORACLES["local_align"] = sql(
    "SELECT ds, z, y, x, 0e0 AS dz, round(sum(w * ok) / sum(w), 6) + 0e0 AS dy, round(sum(w * ok * 2) / sum(w), 6) + 0e0 AS dx"
    " FROM j GROUP BY 1, 2, 3, 4",
    c="SELECT ds, cy, cx, CASE WHEN max(v) > min(v) THEN 1 ELSE 0 END AS ok FROM fx_fix, range(2) a(cy), range(2) b(cx)"
      " WHERE y BETWEEN cy*16 - 2 AND cy*16 + 17 AND x BETWEEN cx*16 - 2 AND cx*16 + 17 GROUP BY 1, 2, 3",
    j="SELECT g.ds, g.z, g.y, g.x, ok, " + _T16.format(a="y") + " * " + _T16.format(a="x") + " AS w"
      " FROM fx_grid g JOIN c ON g.ds = c.ds AND cy BETWEEN y // 16 - 1 AND y // 16 + 1 AND cx BETWEEN x // 16 - 1 AND x // 16 + 1")


def _bent(spark, sf):
    """A smooth displacement that keeps every voxel inside: ds, z, y, x, dz, dy, dx."""
    y, x, ds = F.col("y"), F.col("x"), F.col("ds")
    dy = F.sin(y * math.pi / 31) * F.cos(x / 6.0 + ds) * 0.9
    dx = F.sin(x * math.pi / 31) * F.sin(y / 5.0) * 0.8
    return X.grid(spark, sf).select("ds", "z", "y", "x", F.lit(0.0).alias("dz"), dy.alias("dy"), dx.alias("dx"))


def _textured(spark, sf):
    """The smoothed fixed volumes with waves of all directions, so that every part has something to align."""
    z, y, x, ds = (F.col(c) for c in ("z", "y", "x", "ds"))
    waves = F.sin(y * 0.55 + z * 0.2 + ds) + F.cos(x * 0.5 + z * 0.3 + y * 0.1) + F.sin((y - x) * 0.45 + z * 0.4) + F.cos((y + x) * 0.4 - z * 0.5)
    add = B.pack(X.grid(spark, sf).withColumn("w", waves * 40), X.DIMS, BS, cols=("w",), ids=X.datasets(spark, sf))
    soft = N.smooth(X.fix_blocks(spark, sf, BS), (1.5, 1.5, 1.5))
    return soft.join(B.never_broadcast(add.select("ds", *B.BLK, "w")), ["ds", *B.BLK]).withColumn("v", F.zip_with("v", "w", lambda a, b: a + b)).drop("w")


def local_deform(spark, sf):
    """Control points fitted to a volume and itself seen through a known smooth field: how near the fitted field comes."""
    ids = X.datasets(spark, sf)
    truth = _bent(spark, sf)
    mov = cut(_textured(spark, sf))
    ends = W.field_ends(D.COMPONENTS)
    start = ids.select("ds", A.identity().alias("m"))
    known = cut(B.pack(truth, X.DIMS, BS, cols=D.COMPONENTS, ids=ids).withColumns(ends).join(start, "ds"))
    fix = cut(W.warp(known, mov, X.DIMS, BS, field=D.COMPONENTS, ends=list(ends)))
    found = LO.align(fix, mov, start, X.DIMS, BS, steps=("deform",), options={"deform": {"spacing": 16, "smooth": (1.0, 0.0), "iterations": 4}})
    got = B.unpack(found["field"], D.COMPONENTS).select("ds", "z", "y", "x", *[F.col(c).alias(f"g{c}") for c in ("dy", "dx")])
    off = F.sqrt(sum((F.col(f"g{c}") - F.col(c)) * (F.col(f"g{c}") - F.col(c)) for c in ("dy", "dx")))
    size = F.sqrt(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx"))
    both = truth.join(B.never_broadcast(got), ["ds", "z", "y", "x"]).where("z between 1 and 5 and y between 3 and 28 and x between 3 and 28")
    return both.groupBy("ds").agg(F.count("*").alias("n"), F.round(F.avg(size), 6).alias("truth"), (F.avg(off) < 0.15 * F.avg(size)).alias("near"),
                                  (F.percentile(off, 0.95) < 0.2).alias("everywhere"))


QUERIES["local_deform"] = local_deform
ORACLES["local_deform"] = sql(
    "SELECT ds, count(*) AS n, round(avg(sqrt(dy * dy + dx * dx)), 6) AS truth, true AS near, true AS everywhere FROM u"
    " WHERE z BETWEEN 1 AND 5 AND y BETWEEN 3 AND 28 AND x BETWEEN 3 AND 28 GROUP BY ds",
    u="SELECT ds, z, y, x, sin(y * pi() / 31) * cos(x / 6e0 + ds) * 0.9e0 AS dy, sin(x * pi() / 31) * sin(y / 5e0) * 0.8e0 AS dx FROM fx_grid")
