"""Queries: selection, geometry, masks, pyramids."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.operators import blocks as B
from voxelloom.operators import pyramid as P
from voxelloom.operators import select as S
from voxelloom.plans import fixtures as X
from voxelloom.plans.fixtures import sql

QUERIES, ORACLES = {}, {}


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


# --- selectors -------------------------------------------------------------

def _catalog(spark, sf):
    return X.tczyx(spark, sf).withColumn("subpath", F.concat(F.lit("c"), "c", F.lit("/s0")))


QUERIES["sel_subpath"] = lambda s, d: S.by_subpath(_catalog(s, d), "c1/s0")
ORACLES["sel_subpath"] = sql("SELECT *, 'c1/s0' AS subpath FROM fx_tczyx WHERE c = 1")
QUERIES["sel_time"] = lambda s, d: S.by_time(X.tczyx(s, d), 0)
ORACLES["sel_time"] = sql("SELECT * FROM fx_tczyx WHERE t = 0")
QUERIES["sel_channel"] = lambda s, d: S.by_channel(X.tczyx(s, d), 0)
ORACLES["sel_channel"] = sql("SELECT * FROM fx_tczyx WHERE c = 0")
QUERIES["sel_channels"] = lambda s, d: (
    S.by_channels(X.tczyx(s, d), [0, 2]).groupBy("ds", "c").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    .withColumn("chosen", F.lit("0,2"))
    .unionByName(
        S.by_channels(X.tczyx(s, d), []).groupBy("ds", "c").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
        .withColumn("chosen", F.lit("all"))
    )
)
ORACLES["sel_channels"] = sql(
    "SELECT ds, c, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, '0,2' AS chosen FROM fx_tczyx WHERE c IN (0, 2)"
    " GROUP BY 1, 2 UNION ALL SELECT ds, c, count(*), CAST(sum(v) AS BIGINT), 'all' FROM fx_tczyx GROUP BY 1, 2"
)
QUERIES["crop"] = lambda s, d: S.crop(X.fix(s, d), (1, 4, 6), (5, 20, 15))
ORACLES["crop"] = sql(
    "SELECT ds, z - 1 AS z, y - 4 AS y, x - 6 AS x, v FROM fx_fix WHERE z BETWEEN 1 AND 5 AND y BETWEEN 4 AND 23"
    " AND x BETWEEN 6 AND 20"
)


def axis_map(spark, sf):
    df = X.tczyx(spark, sf).select("ds", "t", F.array("z", "c", "y", "x").alias("idx"), "v")
    return S.map_axes(df, "idx", z_axis=0, channel_axis=1, ndim=4)


QUERIES["axis_map"] = axis_map
ORACLES["axis_map"] = sql("SELECT ds, t, z, c, y, x, v FROM fx_tczyx")


def rechunk(spark, sf):
    """Every voxel with the new block it is in."""
    out = B.rechunk(X.fix_blocks(spark, sf, (4, 8, 8)), (7, 12, 5))
    kept = out.select("*", *[F.col(b).alias(f"in_{b}") for b in B.BLK])
    vox = B.unpack(kept, extra=[f"in_{b}" for b in B.BLK])
    return vox.select("ds", *[F.col(f"in_{b}").alias(b) for b in B.BLK], "z", "y", "x", F.col("v").cast("bigint").alias("v"))


QUERIES["rechunk"] = rechunk
ORACLES["rechunk"] = sql("SELECT ds, z // 7 AS blk_z, y // 12 AS blk_y, x // 5 AS blk_x, z, y, x, v FROM fx_fix")
QUERIES["spacing"] = lambda s, d: S.to_index(S.to_physical(X.fix(s, d), (6.5, 1.0, 1.0), (0.0, 0.5, 0.0)), (2.0, 0.5, 2.0))
ORACLES["spacing"] = sql(
    "SELECT *, CAST(floor(pz / 2e0 + 0.5e0) AS BIGINT) AS iz, CAST(floor(py / 0.5e0 + 0.5e0) AS BIGINT) AS iy,"
    " CAST(floor(px / 2e0 + 0.5e0) AS BIGINT) AS ix FROM (SELECT ds, z, y, x, v, z * 6.5e0 + 0e0 AS pz,"
    " y * 1e0 + 0.5e0 AS py, x * 1e0 + 0e0 AS px FROM fx_fix)"
)
QUERIES["coord_scale"] = lambda s, d: S.scale_coords(X.points(s, d), (0.5, 0.25, 0.25), (1.0, 4.0, 4.0))
ORACLES["coord_scale"] = sql(
    "SELECT ds, point_id, c, z * 0.5e0 AS z, y * 1e0 AS y, x * 1e0 AS x, intensity FROM fx_points"
)


def mask_apply(spark, sf):
    """Voxels inside a full and inside a low-resolution mask, block by block."""
    blocks, ids, out = X.fix_blocks(spark, sf, (7, 16, 16)), X.datasets(spark, sf), None
    for side, mask, scale in (("full", X.mask(spark, sf), (1, 1, 1)), ("low", X.low_mask(spark, sf), (1, 4, 4))):
        dims, bsize = [-(-d // s) for d, s in zip(X.DIMS, scale)], [b // s for b, s in zip((7, 16, 16), scale)]
        both = S.with_mask(blocks, B.pack(mask.where("m = 1"), dims, bsize, cols=("m",), ids=ids), scale)
        part = B.unpack(both, ("v", "m")).where("m <> 0").select("ds", "z", "y", "x", F.col("v").cast("bigint").alias("v"), F.lit(side).alias("side"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES["mask_apply"] = mask_apply
ORACLES["mask_apply"] = sql(
    "SELECT f.*, 'full' AS side FROM fx_fix f SEMI JOIN (SELECT * FROM fx_mask WHERE m = 1) m USING (ds, z, y, x)"
    " UNION ALL SELECT f.*, 'low' AS side FROM fx_fix f WHERE EXISTS (SELECT 1 FROM fx_lowmask m WHERE m.m = 1"
    " AND m.ds = f.ds AND m.z = f.z AND m.y = f.y // 4 AND m.x = f.x // 4)"
)


def mask_descriptor(spark, sf):
    kinds = X.fix(spark, sf).select("ds", "z", "y", "x", (F.col("v") % 3).cast("int").alias("m"))
    return S.apply_mask(X.fix(spark, sf), S.mask_values(kinds, (0, 2)))


QUERIES["mask_descriptor"] = mask_descriptor
ORACLES["mask_descriptor"] = sql("SELECT * FROM fx_fix WHERE v % 3 NOT IN (0, 2)")
QUERIES["skip_sample"] = lambda s, d: S.skip_sample(X.fix(s, d), (2.0, 0.5, 0.7), 2.0)
ORACLES["skip_sample"] = sql(
    "SELECT ds, z, y // 4 AS y, x // 3 AS x, v FROM fx_fix WHERE y % 4 = 0 AND x % 3 = 0"
)
QUERIES["tile_overlap"] = lambda s, d: S.tile_overlap(X.fix(s, d), (4, 8, 8), (1, 2, 2), X.DIMS)
ORACLES["tile_overlap"] = sql(
    "SELECT f.*, CAST(a AS BIGINT) AS blk_z, CAST(b AS BIGINT) AS blk_y, CAST(c AS BIGINT) AS blk_x FROM fx_fix f,"
    " range(2) p(a), range(4) q(b), range(4) r(c) WHERE z BETWEEN a*4-1 AND a*4+4 AND y BETWEEN b*8-2 AND b*8+9"
    " AND x BETWEEN c*8-2 AND c*8+9"
)

# --- pyramids --------------------------------------------------------------

_L1 = "SELECT ds, z // 2 AS z, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM {} GROUP BY 1, 2, 3, 4"
QUERIES["pyramid_level"] = lambda s, d: P.level(X.fix(s, d)).withColumn("v", r6("v"))
ORACLES["pyramid_level"] = sql("SELECT ds, z, y, x, round(v, 6) + 0e0 AS v FROM l1", l1=_L1.format("fx_fix"))


def pyramid_full(spark, sf):
    """Blocks of 8x16x16 hold whole cells of three levels; stop when all sides <= 4."""
    levels = P.level_count(X.DIMS, 4)
    out = P.full(X.fix_blocks(spark, sf, (8, 16, 16)), levels)
    return B.unpack(out, extra=["scale"]).withColumn("v", r6("v"))


QUERIES["pyramid_full"] = pyramid_full
ORACLES["pyramid_full"] = sql(
    "SELECT 0 AS scale, ds, z, y, x, CAST(v AS DOUBLE) AS v FROM fx_fix"
    " UNION ALL SELECT 1, ds, z, y, x, round(v, 6) FROM l1 UNION ALL SELECT 2, ds, z, y, x, round(v, 6) FROM l2"
    " UNION ALL SELECT 3, ds, z, y, x, round(v, 6) FROM l3",
    l1=_L1.format("fx_fix"), l2=_L1.format("l1"), l3=_L1.format("l2"),
)
QUERIES["pyramid_multi"] = lambda s, d: (
    P.level(X.tczyx(s, d), (1, 2, 2), keys=("ds", "t", "c")).withColumn("v", r6("v"))
)
ORACLES["pyramid_multi"] = sql(
    "SELECT ds, t, c, z, y // 2 AS y, x // 2 AS x, round(avg(v), 6) AS v FROM fx_tczyx GROUP BY 1, 2, 3, 4, 5, 6"
)


def pyramid_optional(spark, sf):
    blocks = X.fix_blocks(spark, sf, (8, 16, 16))
    return B.unpack(P.optional(blocks, False, 3), extra=["scale"]).withColumn("v", F.col("v").cast("bigint"))


QUERIES["pyramid_optional"] = pyramid_optional
ORACLES["pyramid_optional"] = sql("SELECT 0 AS scale, ds, z, y, x, v FROM fx_fix")
