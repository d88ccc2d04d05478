"""Queries: thresholds, order statistics, filters, correlation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.operators import blocks as B
from voxelloom.operators import filters as N
from voxelloom.operators import pyramid as P
from voxelloom.operators import stats as T
from voxelloom.plans import fixtures as X
from voxelloom.plans.fixtures import sql
from voxelloom.plans.q_select import r6
from voxelloom.session import cut

QUERIES, ORACLES = {}, {}

QUERIES["foreground_mask"] = lambda s, d: T.above_quantile(X.fix(s, d), 0.8)
_FG = ("SELECT ds, z, y, x, v, CASE WHEN v > q THEN 1 ELSE 0 END AS m FROM fx_fix JOIN"
       " (SELECT ds, quantile_cont(v, 0.8) AS q FROM fx_fix GROUP BY ds) USING (ds)")
ORACLES["foreground_mask"] = sql(_FG)
QUERIES["foreground_otsu"] = lambda s, d: T.above_otsu(X.fix(s, d))
ORACLES["foreground_otsu"] = sql(
    "SELECT ds, z, y, x, v, CASE WHEN bin > otsu_bin THEN 1 ELSE 0 END AS m FROM b JOIN (SELECT ds, arg_max(bin, k) AS"
    " otsu_bin FROM (SELECT ds, bin, row(var, -bin) AS k FROM w) GROUP BY ds) USING (ds)",
    span="SELECT ds, CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi, count(*) AS total FROM fx_fix GROUP BY ds",
    b="SELECT f.*, total, CASE WHEN hi > lo THEN CAST(least(floor((v - lo) * 256e0 / (hi - lo)), 255) AS BIGINT) ELSE 0"
      " END AS bin FROM fx_fix f JOIN span USING (ds)",
    h="SELECT ds, bin, total, count(*) AS n FROM b GROUP BY 1, 2, 3",
    c="SELECT ds, bin, CAST(total AS DOUBLE) AS total, CAST(sum(n) OVER u AS DOUBLE) AS w0,"
      " CAST(sum(n * bin) OVER u AS DOUBLE) AS s0, CAST(sum(n * bin) OVER (PARTITION BY ds) AS DOUBLE) AS s FROM h"
      " WINDOW u AS (PARTITION BY ds ORDER BY bin)",
    w="SELECT ds, bin, CASE WHEN w0 < total THEN (s0*total - s*w0)*(s0*total - s*w0) / (w0*(total - w0)) ELSE 0 END AS var FROM c",
)


def foreground_clean(spark, sf):
    m = T.above_quantile(X.fix(spark, sf), 0.8)
    blocks = B.pack(m, X.DIMS, (4, 16, 16), cols=("m",), ids=X.datasets(spark, sf))
    out = N.morphology(blocks, ["dilate", "erode"])
    return B.unpack(out, ("m",)).withColumn("m", F.col("m").cast("int"))


_NEAR = (" JOIN {t} b ON a.ds = b.ds AND b.z BETWEEN a.z-1 AND a.z+1 AND b.y BETWEEN a.y-1 AND a.y+1"
         " AND b.x BETWEEN a.x-1 AND a.x+1")
QUERIES["foreground_clean"] = foreground_clean
ORACLES["foreground_clean"] = sql(
    "SELECT a.ds, a.z, a.y, a.x, min(b.m) AS m FROM dil a" + _NEAR.format(t="dil") + " GROUP BY 1, 2, 3, 4",
    fg=_FG, dil="SELECT a.ds, a.z, a.y, a.x, max(b.m) AS m FROM fg a" + _NEAR.format(t="fg") + " GROUP BY 1, 2, 3, 4",
)
QUERIES["winsorize"] = lambda s, d: T.winsorize(X.fix(s, d), 0.05, 0.02).withColumn("v", r6("v"))
ORACLES["winsorize"] = sql(
    "SELECT ds, z, y, x, round(least(greatest(CAST(v AS DOUBLE), lo), hi), 6) AS v FROM fx_fix JOIN (SELECT ds,"
    " quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.98) AS hi FROM fx_fix GROUP BY ds) USING (ds)"
)
QUERIES["prob_threshold"] = lambda s, d: X.prob(s, d).where(F.col("p") > 0.125)
ORACLES["prob_threshold"] = sql("SELECT * FROM fx_prob WHERE p > 0.125e0")


def gauss_ctes(source: str, col: str, sigma: float, out: str, dims=X.DIMS) -> dict[str, str]:
    """SQL of the three smoothing passes with border repetition."""
    ks = N.gauss_weights(sigma)
    r = len(ks) // 2
    w = ", ".join(f"({k - r}, {float(v)!r}::DOUBLE)" for k, v in enumerate(ks))
    ctes, prev = {f"{out}_w": f"SELECT * FROM (VALUES {w}) AS t(k, w)"}, source
    for i, a in enumerate("xyz" if out else ""):
        n = dims["zyx".index(a)] - 1
        rest = [b for b in "zyx" if b != a]
        same = " AND ".join(f"s.{b} = g.{b}" for b in ["ds", *rest])
        name = out if i == 2 else f"{out}_{a}"
        ctes[name] = (
            f"SELECT g.ds, g.z, g.y, g.x, sum(w * s.{col if i == 0 else 'v'}) AS v FROM {source} g CROSS JOIN {out}_w"
            f" JOIN {prev} s ON {same} AND s.{a} = least(greatest(g.{a} + k, 0), {n}) GROUP BY 1, 2, 3, 4"
        )
        prev = name
    return ctes


QUERIES["gauss_smooth"] = lambda s, d: B.unpack(N.smooth(X.fix_blocks(s, d, (7, 16, 16)), (1.0, 1.0, 1.0))).withColumn("v", r6("v"))
ORACLES["gauss_smooth"] = sql("SELECT ds, z, y, x, round(v, 6) + 0e0 AS v FROM g", **gauss_ctes("fx_fix", "v", 1.0, "g"))
QUERIES["segment_preproc"] = lambda s, d: (
    B.unpack(N.smooth(X.fix_blocks(s, d, (4, 16, 16)), (0.5, 0.5, 0.5))).withColumn("foreground", F.col("v") > 2.5).withColumn("v", r6("v"))
)
ORACLES["segment_preproc"] = sql(
    "SELECT ds, z, y, x, round(v, 6) + 0e0 AS v, v > 2.5 AS foreground FROM g", **gauss_ctes("fx_fix", "v", 0.5, "g"))
QUERIES["dog"] = lambda s, d: B.unpack(N.dog(X.fix_blocks(s, d, (7, 16, 16)), 0.6, 1.0)).withColumn("v", r6("v"))
ORACLES["dog"] = sql(
    "SELECT ds, z, y, x, round(a.v - b.v, 6) + 0e0 AS v FROM ga a JOIN gb b USING (ds, z, y, x)",
    **gauss_ctes("fx_fix", "v", 0.6, "ga"), **gauss_ctes("fx_fix", "v", 1.0, "gb"))
QUERIES["shrink"] = lambda s, d: P.level(X.fix(s, d), (1, 4, 3)).withColumn("v", r6("v"))
ORACLES["shrink"] = sql(
    "SELECT ds, z, y // 4 AS y, x // 3 AS x, round(avg(v), 6) + 0e0 AS v FROM fx_fix GROUP BY 1, 2, 3, 4")

_PEAK = (
    "SELECT a.ds, a.z, a.y, a.x, a.v FROM fx_fix a" + _NEAR.format(t="fx_fix")
    + " WHERE NOT (a.z = b.z AND a.y = b.y AND a.x = b.x) GROUP BY 1, 2, 3, 4, 5 HAVING max(b.v) < a.v"
)
QUERIES["local_max"] = lambda s, d: N.local_max(X.fix_blocks(s, d, (4, 16, 16))).withColumn("v", F.col("v").cast("bigint"))
ORACLES["local_max"] = sql(_PEAK)


def blob_laplace(spark, sf):
    """Laplacian response of at least 1 and at least 0.3 of the dataset's strongest."""
    lap = cut(B.unpack(N.laplace(X.fix_blocks(spark, sf, (4, 16, 16)))).where("v >= 1"))
    top = lap.groupBy("ds").agg(F.max("v").alias("top"))
    return lap.join(top, "ds").where(F.col("v") >= 0.3 * F.col("top")).select(
        "ds", "z", "y", "x", F.col("v").cast("bigint").alias("response"))


QUERIES["blob_laplace"] = blob_laplace
ORACLES["blob_laplace"] = sql(
    "SELECT ds, z, y, x, response FROM lap JOIN (SELECT ds, max(response) AS top FROM lap GROUP BY ds) USING (ds)"
    " WHERE response >= greatest(1e0, 0.3e0 * top)",
    lap="SELECT ds, z, y, x, CAST(6 * v - (" + " + ".join(
        f"coalesce(lag(v) OVER w{a}, v) + coalesce(lead(v) OVER w{a}, v)" for a in "zyx") + ") AS BIGINT) AS response FROM fx_fix WINDOW "
        + ", ".join(f"w{a} AS (PARTITION BY ds, {', '.join(b for b in 'zyx' if b != a)} ORDER BY {a})" for a in "zyx"),
)

_SUMS = ("count(*)::DOUBLE AS n, sum(a)::DOUBLE AS sa, sum(b)::DOUBLE AS sb, sum(a*a)::DOUBLE AS saa,"
         " sum(b*b)::DOUBLE AS sbb, sum(a*b)::DOUBLE AS sab")
_R = ("CASE WHEN n*saa - sa*sa > 0 AND n*sbb - sb*sb > 0 THEN round((n*sab - sa*sb) / (sqrt(n*saa - sa*sa) *"
      " sqrt(n*sbb - sb*sb)), 6) END AS r")
_PAIR = "SELECT f.ds, f.z, f.y, f.x, f.v AS a, m.v AS b FROM fx_fix f JOIN fx_mov m USING (ds, z, y, x)"
QUERIES["corr_block"] = lambda s, d: T.corr_blocks(X.fix_blocks(s, d, (7, 8, 8)), X.mov_blocks(s, d, (7, 8, 8))).select(
    "ds", "blk_z", "blk_y", "blk_x", F.col("n").cast("bigint").alias("n"), F.round("r", 6).alias("r"))
ORACLES["corr_block"] = sql(
    "SELECT ds, blk_z, blk_y, blk_x, CAST(n AS BIGINT) AS n, " + _R + " FROM s", p=_PAIR,
    s="SELECT ds, z // 7 AS blk_z, y // 8 AS blk_y, x // 8 AS blk_x, " + _SUMS + " FROM p GROUP BY 1, 2, 3, 4")
QUERIES["corr_global"] = lambda s, d: T.corr_global(X.fix_blocks(s, d, (7, 16, 16)), X.mov_blocks(s, d, (7, 16, 16))).select(
    "ds", F.col("n").cast("bigint").alias("n"), F.round("r", 6).alias("r"))
ORACLES["corr_global"] = sql(
    "SELECT ds, CAST(n AS BIGINT) AS n, " + _R + " FROM s", p=_PAIR, s="SELECT ds, " + _SUMS + " FROM p GROUP BY 1")
QUERIES["corr_spacing"] = lambda s, d: T.corr_spaced(
    X.fix(s, d), P.level(X.mov(s, d), (1, 2, 2)), (1.0, 1.0, 1.0), (1.0, 2.0, 2.0), (7, 8, 8)
).select("ds", "blk_z", "blk_y", "blk_x", F.col("n").cast("bigint").alias("n"), F.round("r", 6).alias("r"))
ORACLES["corr_spacing"] = sql(
    "SELECT ds, blk_z, blk_y, blk_x, CAST(n AS BIGINT) AS n, " + _R + " FROM s",
    m="SELECT ds, z, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM fx_mov GROUP BY 1, 2, 3, 4",
    p="SELECT f.ds, f.z, f.y, f.x, CAST(f.v AS DOUBLE) AS a, m.v AS b FROM fx_fix f JOIN m ON m.ds = f.ds AND m.z = f.z"
      " AND m.y = floor(f.y / 2e0 + 0.5e0) AND m.x = floor(f.x / 2e0 + 0.5e0)",
    s="SELECT ds, z // 7 AS blk_z, y // 8 AS blk_y, x // 8 AS blk_x, " + _SUMS + " FROM p GROUP BY 1, 2, 3, 4")
QUERIES["corr_local"] = lambda s, d: B.unpack(
    N.local_corr(X.fix_blocks(s, d, (7, 16, 16)), X.mov_blocks(s, d, (7, 16, 16)), 1), ("r",)
).withColumn("r", F.when(~F.isnan("r"), r6("r")))
ORACLES["corr_local"] = sql(
    "SELECT ds, z, y, x, r + 0e0 AS r FROM (SELECT ds, z, y, x, " + _R + " FROM s)", p=_PAIR,
    q="SELECT ds, z, y, x, a AS qa, b AS qb FROM p",
    s="SELECT k.ds, k.z, k.y, k.x, " + _SUMS + " FROM q k JOIN p ON k.ds = p.ds AND p.z BETWEEN k.z-1 AND k.z+1"
      " AND p.y BETWEEN k.y-1 AND k.y+1 AND p.x BETWEEN k.x-1 AND k.x+1 GROUP BY 1, 2, 3, 4",
)
