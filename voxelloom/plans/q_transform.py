"""Queries: affines, sampling, warps, coordinate transforms, displacement fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.functions import affine as A
from voxelloom.operators import blocks as B
from voxelloom.operators import fields as D
from voxelloom.operators import warp as W
from voxelloom.plans import fixtures as X
from voxelloom.plans.fixtures import sql
from voxelloom.plans.q_select import r6

QUERIES, ORACLES = {}, {}
BS = (4, 16, 16)


def _blocks(df, value="v"):
    return B.unpack(df).withColumn("v", r6("v"))


def _field(df):
    return B.unpack(df, D.COMPONENTS).select("ds", "z", "y", "x", *[r6(c).alias(c) for c in D.COMPONENTS])


def _affine(spark, sf, seq=1):
    return X.affines(spark, sf).where(F.col("seq") == seq).drop("seq")


def _grid(spark, sf):
    """Target grid as block rows without values."""
    return B.block_skeleton(X.datasets(spark, sf), X.DIMS, BS).withColumns(
        {"dims": B._lit_array(X.DIMS), "bsize": B._lit_array(BS)})


# --- SQL pieces --------------------------------------------------------------

_O8 = "SELECT * FROM range(2) a(oz), range(2) b(oy), range(2) c(ox)"
_M1 = "SELECT * FROM fx_affine WHERE seq = 1"


def _apply(m, p):
    return [f"({m}.m{i}0 * {p[0]} + {m}.m{i}1 * {p[1]} + {m}.m{i}2 * {p[2]} + {m}.m{i}3)" for i in range(3)]


def _sample(pos, source, cols, keys):
    """SELECT of trilinear samples: `pos` has keys and pz, py, px; 0 outside."""
    w = " * ".join(f"(CASE WHEN o{a} = 1 THEN p{a} - floor(p{a}) ELSE 1 - (p{a} - floor(p{a})) END)" for a in "zyx")
    on = " AND ".join(f"s.{a} = CAST(floor(p{a}) AS BIGINT) + o{a}" for a in "zyx")
    k = ", ".join(f"p.{c}" for c in keys)
    vals = ", ".join(f"sum(coalesce(s.{c}, 0) * {w}) AS s{c}" for c in cols)
    return f"SELECT {k}, {vals} FROM {pos} p CROSS JOIN o8 LEFT JOIN {source} s ON s.ds = p.ds AND {on} GROUP BY ALL"


_X = ["z", "y", "x"]

# --- affines -------------------------------------------------------------------

QUERIES["affine_invert"] = lambda s, d: X.affines(s, d).select("ds", "seq", *A.columns(A.invert(F.col("m"))))
_cof = [[f"(m{(j+1)%3}{(i+1)%3}*m{(j+2)%3}{(i+2)%3} - m{(j+1)%3}{(i+2)%3}*m{(j+2)%3}{(i+1)%3})" for j in range(3)] for i in range(3)]
ORACLES["affine_invert"] = sql(
    "SELECT ds, seq, " + ", ".join(
        [f"round({_cof[i][j]} / det, 6) + 0e0 AS m{i}{j}" for i in range(3) for j in range(3)]
        + [f"round(-({_cof[i][0]}*m03 + {_cof[i][1]}*m13 + {_cof[i][2]}*m23) / det, 6) + 0e0 AS m{i}3" for i in range(3)])
    + " FROM a", a=f"SELECT *, m00*{_cof[0][0]} + m01*{_cof[1][0]} + m02*{_cof[2][0]} AS det FROM fx_affine")

# --- sampling and warps ----------------------------------------------------------

QUERIES["sample_trilinear"] = lambda s, d: W.sample_points(
    X.points(s, d), X.fix_blocks(s, d, BS), src_bsize=BS, chunk=100).withColumn("v", r6("v"))
ORACLES["sample_trilinear"] = sql(
    "SELECT ds, point_id, round(sv, 6) + 0e0 AS v FROM s", o8=_O8,
    p="SELECT ds, point_id, z AS pz, y AS py, x AS px FROM fx_points", s=_sample("p", "fx_fix", ["v"], ["ds", "point_id"]))
QUERIES["warp_affine"] = lambda s, d: _blocks(
    W.warp(W.with_grid(_grid(s, d), _affine(s, d)), X.mov_blocks(s, d, BS), X.DIMS, BS))
_p = _apply("m", ["g.z", "g.y", "g.x"])
_pos = "SELECT g.ds, g.z, g.y, g.x, {} AS pz, {} AS py, {} AS px FROM {} g JOIN {} m ON m.ds = g.ds"
_K = ["ds", "z", "y", "x"]
ORACLES["warp_affine"] = sql(
    "SELECT ds, z, y, x, round(sv, 6) + 0e0 AS v FROM s", o8=_O8, m1=_M1,
    p=_pos.format(*_p, "fx_grid", "m1"), s=_sample("p", "fx_mov", ["v"], _K))


def deform(spark, sf):
    """Fixed grid with in-plane spacing 0.5, moving volume with spacing 1."""
    target = W.with_grid(X.disp_blocks(spark, sf, BS), A.chain(X.affines(spark, sf)))
    return _blocks(W.warp(target, X.mov_blocks(spark, sf, BS), X.DIMS, BS, field=D.COMPONENTS, spacing=(1.0, 0.5, 0.5)))


QUERIES["deform"] = deform
_A1 = _apply("a", ["q.z0", "q.y0", "q.x0"])
_CHAIN = (
    "SELECT a.ds, " + ", ".join(
        f"b.m{i}0*a.m0{j} + b.m{i}1*a.m1{j} + b.m{i}2*a.m2{j}" + (f" + b.m{i}3" if j == 3 else "") + f" AS m{i}{j}"
        for i in range(3) for j in range(4))
    + " FROM fx_affine a JOIN fx_affine b ON a.ds = b.ds AND a.seq = 1 AND b.seq = 2"
)
ORACLES["deform"] = sql(
    "SELECT ds, z, y, x, round(sv, 6) + 0e0 AS v FROM s", o8=_O8, m2=_CHAIN,
    p=_pos.format(*_apply("m", ["(g.z + g.dz)", "(g.y*0.5e0 + g.dy)", "(g.x*0.5e0 + g.dx)"]), "fx_disp", "m2"),
    s=_sample("p", "fx_mov", ["v"], _K))


def extra_deforms(spark, sf):
    """Each sample lists further images; all are warped by the sample's transform in one job."""
    images = X.fix_blocks(spark, sf, BS).withColumn("image", F.lit("c0")).unionByName(
        X.mov_blocks(spark, sf, BS).withColumn("image", F.lit("c1")))
    extra = X.datasets(spark, sf).select(
        "ds", F.explode(F.array(*[F.struct(F.lit(i).alias("image"), F.lit(f"warped/{i}").alias("output")) for i in ("c0", "c1")])).alias("e")
    ).select("ds", "e.*")
    target = W.with_grid(X.disp_blocks(spark, sf, BS), _affine(spark, sf)).join(extra, "ds")
    out = W.warp(target, images, X.DIMS, BS, keys=("ds", "image"), field=D.COMPONENTS)
    out = B.unpack(out, keys=("ds", "image")).join(extra, ["ds", "image"])
    return out.select("ds", "output", "z", "y", "x", r6("v").alias("v"))


QUERIES["extra_deforms"] = extra_deforms
ORACLES["extra_deforms"] = sql(
    "SELECT ds, 'warped/c0' AS output, z, y, x, round(sv, 6) + 0e0 AS v FROM s0 UNION ALL"
    " SELECT ds, 'warped/c1', z, y, x, round(sv, 6) + 0e0 FROM s1", o8=_O8, m1=_M1,
    p=_pos.format(*_apply("m", ["(g.z + g.dz)", "(g.y + g.dy)", "(g.x + g.dx)"]), "fx_disp", "m1"),
    s0=_sample("p", "fx_fix", ["v"], _K), s1=_sample("p", "fx_mov", ["v"], _K))

# --- coordinates -------------------------------------------------------------------

QUERIES["transform_coords_affine"] = lambda s, d: W.transform_coords(
    X.points(s, d), A.chain(X.affines(s, d)), resolution=(0.5, 0.25, 0.25), downsampling=(1.0, 4.0, 4.0)
).select("ds", "point_id", *[r6(a).alias(a) for a in "zyx"])
_PP = _apply("m", ["(p.z*0.5e0)", "(p.y*1e0)", "(p.x*1e0)"])
ORACLES["transform_coords_affine"] = sql(
    "SELECT p.ds, point_id, " + ", ".join(f"round({e}, 6) + 0e0 AS {a}" for e, a in zip(_PP, "zyx"))
    + " FROM fx_points p JOIN m2 m ON m.ds = p.ds", m2=_CHAIN)
QUERIES["transform_coords"] = lambda s, d: W.transform_coords(
    X.points(s, d), _affine(s, d), X.disp_blocks(s, d, BS), field_bsize=BS,
).select("ds", "point_id", *[r6(a).alias(a) for a in "zyx"])
ORACLES["transform_coords"] = sql(
    "SELECT p.ds, point_id, round(pz + sdz, 6) + 0e0 AS z, round(py + sdy, 6) + 0e0 AS y, round(px + sdx, 6) + 0e0 AS x"
    " FROM p JOIN s USING (ds, point_id)", o8=_O8, m1=_M1,
    p="SELECT p.ds, point_id, {} AS pz, {} AS py, {} AS px FROM fx_points p JOIN m1 m ON m.ds = p.ds".format(
        *_apply("m", ["p.z", "p.y", "p.x"])),
    s=_sample("p", "fx_disp", ["dz", "dy", "dx"], ["ds", "point_id"]))

# --- fields ----------------------------------------------------------------------


def _inverse_sql(step, rounds):
    """Unrolled fixed point of the inverse field in SQL."""
    ctes = {"o8": _O8, "u0": "SELECT ds, z, y, x, 0e0 AS uz, 0e0 AS uy, 0e0 AS ux FROM fx_grid"}
    for k in range(1, rounds + 1):
        ctes[f"p{k}"] = f"SELECT *, z + uz AS pz, y + uy AS py, x + ux AS px FROM u{k-1}"
        ctes[f"s{k}"] = _sample(f"p{k}", "fx_disp", ["dz", "dy", "dx"], _K)
        ctes[f"u{k}"] = "SELECT p.ds, p.z, p.y, p.x, " + ", ".join(
            f"u{a} + {step!r}::DOUBLE * (-sd{a} - u{a}) AS u{a}" for a in "zyx") + f" FROM p{k} p JOIN s{k} USING (ds, z, y, x)"
    return sql(f"SELECT ds, z, y, x, " + ", ".join(f"round(u{a}, 6) + 0e0 AS d{a}" for a in "zyx") + f" FROM u{rounds}", **ctes)


QUERIES["field_inverse"] = lambda s, d: _field(D.invert(X.disp_blocks(s, d, BS), iterations=2))
ORACLES["field_inverse"] = _inverse_sql(1.0, 2)
QUERIES["field_inverse_damped"] = lambda s, d: _field(D.invert(X.disp_blocks(s, d, BS), iterations=[1, 2], step=0.5))
ORACLES["field_inverse_damped"] = _inverse_sql(0.5, 3)
QUERIES["compose"] = lambda s, d: _field(
    D.compose(W.with_grid(_grid(s, d), A.chain(X.affines(s, d))), X.disp_blocks(s, d, BS), X.DIMS, BS, affine="m"))
ORACLES["compose"] = sql(
    "SELECT ds, z, y, x, round(sdz + pz - z, 6) + 0e0 AS dz, round(sdy + py - y, 6) + 0e0 AS dy,"
    " round(sdx + px - x, 6) + 0e0 AS dx FROM p JOIN s USING (ds, z, y, x)", o8=_O8, m2=_CHAIN,
    p=_pos.format(*_p, "fx_grid", "m2"), s=_sample("p", "fx_disp", ["dz", "dy", "dx"], _K))
QUERIES["compose_fields"] = lambda s, d: _field(
    D.compose(X.disp_blocks(s, d, BS), X.disp_blocks(s, d, BS), X.DIMS, BS))
ORACLES["compose_fields"] = sql(
    "SELECT ds, z, y, x, round(sdz + pz - z, 6) + 0e0 AS dz, round(sdy + py - y, 6) + 0e0 AS dy,"
    " round(sdx + px - x, 6) + 0e0 AS dx FROM p JOIN s USING (ds, z, y, x)", o8=_O8,
    p="SELECT ds, z, y, x, z + dz AS pz, y + dy AS py, x + dx AS px FROM fx_disp",
    s=_sample("p", "fx_disp", ["dz", "dy", "dx"], _K))


def _block_totals(spark, sf, bsize):
    s = X.sparse(spark, sf)
    base = B.block_skeleton(X.datasets(spark, sf), X.DIMS, bsize)
    t = B.with_block_id(s, bsize).groupBy("ds", *B.BLK).agg(F.sum("v").alias("total"))
    return base.join(t, ["ds", *B.BLK], "left").withColumn("total", F.coalesce("total", F.lit(0).cast("bigint")))


def bspline_field(spark, sf):
    """Control coefficients from the mass of each 8-voxel cell."""
    t = _block_totals(spark, sf, (8, 8, 8))
    c = t.select("ds", *[F.col(b).alias(f"c{a}") for b, a in zip(B.BLK, "zyx")],
                 *[((F.col("total") % n - n // 2) * 0.2718281828).alias(f"d{a}") for a, n in zip("zyx", (5, 7, 9))])
    return _field(D.bspline(c, X.DIMS, 8))


QUERIES["bspline_field"] = bspline_field
_BW = ("CASE {k} WHEN -1 THEN (1-{u})*(1-{u})*(1-{u}) WHEN 0 THEN 3*{u}*{u}*{u} - 6*{u}*{u} + 4"
       " WHEN 1 THEN -3*{u}*{u}*{u} + 3*{u}*{u} + 3*{u} + 1 ELSE {u}*{u}*{u} END / 6e0")
_TOT = ("SELECT ds, z // {0} AS cz, y // {1} AS cy, x // {2} AS cx, CAST(sum(v) AS BIGINT) AS total FROM fx_fix"
        " GROUP BY 1, 2, 3, 4")
ORACLES["bspline_field"] = sql(
    "SELECT ds, z, y, x, " + ", ".join(
        f"round(sum((total % {n} - {n // 2}) * 0.2718281828e0 * wz * wy * wx), 6) + 0e0 AS d{a}" for a, n in zip("zyx", (5, 7, 9)))
    + " FROM j GROUP BY 1, 2, 3, 4", c=_TOT.format(8, 8, 8),
    j="SELECT g.ds, g.z, g.y, g.x, total, " + ", ".join(
        _BW.format(k=f"(c{a} - {a} // 8)", u=f"(({a} % 8) / 8e0)") + f" AS w{a}" for a in "zyx")
      + " FROM fx_grid g JOIN c ON g.ds = c.ds AND " + " AND ".join(f"c{a} - {a} // 8 BETWEEN -1 AND 2" for a in "zyx"))


def field_blend(spark, sf):
    """Per-block shifts from the mass of each block, blended over an overlap of 2 voxels."""
    t = _block_totals(spark, sf, (7, 8, 8))
    shift = [(F.col("total") % n - n // 2).cast("double") for n in (3, 5, 7)]
    t = t.select("ds", *B.BLK, A.translation(*shift).alias("m"))
    return _field(D.blend(t, X.DIMS, (7, 8, 8), (0, 2, 2)))


QUERIES["field_blend"] = field_blend
_TENT = "least(greatest(least({a} - (c{a}*8 - 2) + 0.5e0, (c{a}+1)*8 + 2 - {a} - 0.5e0) / 4e0, 0e0), 1e0)"
ORACLES["field_blend"] = sql(
    "SELECT ds, z, y, x, " + ", ".join(
        f"round(sum(w * (total % {n} - {n // 2})) / sum(w), 6) + 0e0 AS d{a}" for a, n in zip("zyx", (3, 5, 7)))
    + " FROM j GROUP BY 1, 2, 3, 4", c=_TOT.format(7, 8, 8),
    j="SELECT g.ds, g.z, g.y, g.x, total, " + _TENT.format(a="y") + " * " + _TENT.format(a="x") + " AS w"
      " FROM fx_grid g JOIN c ON g.ds = c.ds AND cy BETWEEN y // 8 - 1 AND y // 8 + 1 AND cx BETWEEN x // 8 - 1 AND x // 8 + 1")
