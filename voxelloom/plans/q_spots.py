"""Queries: spots."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.operators import blocks as B
from voxelloom.operators import filters as N
from voxelloom.operators import spots as P
from voxelloom.plans import fixtures as X
from voxelloom.plans.fixtures import sql
from voxelloom.plans.q_filters import _NEAR, _PEAK
from voxelloom.plans.q_select import r6

QUERIES, ORACLES = {}, {}
BS = (7, 16, 16)


def channel_blocks(spark, sf):
    vox = X.tczyx(spark, sf).groupBy("ds", "c", "z", "y", "x").agg(F.sum("v").alias("v"))
    return B.pack(vox, X.DIMS, BS, keys=("ds", "c"))


QUERIES["spots_peak"] = lambda s, d: N.local_max(channel_blocks(s, d), threshold=45.0, keys=("ds", "c")).withColumn(
    "v", F.col("v").cast("bigint"))
_CH = dict(
    g="SELECT g.*, c FROM fx_grid g, range(3) t(c)",
    f="SELECT g.ds, g.c, g.z, g.y, g.x, CAST(coalesce(sum(s.v), 0) AS BIGINT) AS v FROM g LEFT JOIN fx_tczyx s ON g.ds = s.ds AND"
      " g.c = s.c AND g.z = s.z AND g.y = s.y AND g.x = s.x GROUP BY 1, 2, 3, 4, 5",
    pk="SELECT a.ds, a.c, a.z, a.y, a.x, a.v FROM (SELECT * FROM f WHERE v >= 45) a" + _NEAR.format(t="f")
       + " AND a.c = b.c WHERE NOT (a.z = b.z AND a.y = b.y AND a.x = b.x) GROUP BY 1, 2, 3, 4, 5, 6 HAVING max(b.v) < a.v",
)
ORACLES["spots_peak"] = sql("SELECT * FROM pk", **_CH)
QUERIES["spots_channels"] = lambda s, d: N.local_max(channel_blocks(s, d), threshold=45.0, keys=("ds", "c")).groupBy("ds", "c").agg(
    F.count("*").alias("n_spots"), F.sum("v").cast("bigint").alias("total"))
ORACLES["spots_channels"] = sql("SELECT ds, c, count(*) AS n_spots, CAST(sum(v) AS BIGINT) AS total FROM pk GROUP BY 1, 2", **_CH)
_SIGMAS = [0.6, 0.9, 1.2]


def _log_sql(volume):
    """Scale-space blobs of a volume CTE (k, z, y, x, v) in SQL; k names the image."""
    dims = dict(zip("zyx", X.DIMS))
    rng = {a: f"range(-1, {n + 1})" for a, n in dims.items()}
    ctes = {"vol": volume}
    for i, s in enumerate(_SIGMAS):
        ks = N.gauss_weights(s)
        r = len(ks) // 2
        ctes[f"w{i}"] = "SELECT * FROM (VALUES " + ", ".join(f"({j - r}, {float(v)!r}::DOUBLE)" for j, v in enumerate(ks)) + ") AS t(o, w)"
        prev = "vol"
        for a in "zyx":  # one voxel beyond the border along the axes already smoothed
            name = f"s{i}{a}"
            tgt = (f"SELECT CAST(p AS BIGINT) AS {a}, w, least(greatest(p + o, 0), {dims[a] - 1}) AS q FROM {rng[a]} e(p), w{i}")
            ctes[name] = (f"SELECT d.k, {', '.join('t.' + b if b == a else 'd.' + b for b in 'zyx')}, sum(t.w * d.v) AS v"
                          f" FROM ({tgt}) t JOIN {prev} d ON d.{a} = t.q GROUP BY ALL")
            prev = name
        around = " + ".join(f"lag(v) OVER w{a} + lead(v) OVER w{a}" for a in "zyx")
        lines = ", ".join(f"w{a} AS (PARTITION BY k, {', '.join(b for b in 'zyx' if b != a)} ORDER BY {a})" for a in "zyx")
        ctes[f"l{i}"] = (
            f"SELECT * FROM (SELECT k, z, y, x, {i} AS s, {s * s!r}::DOUBLE * (6 * v - ({around})) AS r FROM {prev} WINDOW {lines}) WHERE "
            + " AND ".join(f"{a} BETWEEN 0 AND {n - 1}" for a, n in dims.items()))
    ctes["resp"] = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(len(_SIGMAS)))
    ctes["cand"] = "SELECT * FROM resp WHERE r >= 1"
    ctes["beat"] = (
        "SELECT DISTINCT c.k, c.z, c.y, c.x, c.s FROM (SELECT * FROM cand, range(-1, 2) i(oz), range(-1, 2) j(oy), range(-1, 2) l(ox),"
        " range(-1, 2) m(os) WHERE oz <> 0 OR oy <> 0 OR ox <> 0 OR os <> 0) c JOIN resp n ON n.k = c.k AND n.z = c.z + oz AND"
        " n.y = c.y + oy AND n.x = c.x + ox AND n.s = c.s + os WHERE n.r >= c.r")
    ctes["blob"] = "SELECT * FROM cand ANTI JOIN beat USING (k, z, y, x, s)"
    ctes["top"] = "SELECT k, max(r) AS top FROM blob GROUP BY k"
    ctes["found"] = ("SELECT blob.*, vol.v, CASE s " + " ".join(f"WHEN {i} THEN {v!r}::DOUBLE" for i, v in enumerate(_SIGMAS))
                     + " END AS sigma FROM blob JOIN top USING (k) JOIN vol USING (k, z, y, x) WHERE r >= 0.05 * top")
    return ctes


def _log(blocks, keys):
    b = P.detect_log(blocks, _SIGMAS, 1.0, 0.05, keys=keys)
    return b.select(*keys, "z", "y", "x", "sigma", F.round("response", 6).alias("response"), F.col("v").cast("bigint").alias("v"))


QUERIES["spots_log"] = lambda s, d: _log(channel_blocks(s, d), ("ds", "c"))
ORACLES["spots_log"] = sql(
    "SELECT k // 3 AS ds, k % 3 AS c, z, y, x, sigma, round(r, 6) AS response, v FROM found", g=_CH["g"], f=_CH["f"],
    **_log_sql("SELECT ds * 3 + c AS k, z, y, x, v FROM f"))
QUERIES["blob_log"] = lambda s, d: _log(X.fix_blocks(s, d, BS), ("ds",))
ORACLES["blob_log"] = sql(
    "SELECT k AS ds, z, y, x, sigma, round(r, 6) AS response, v FROM found", **_log_sql("SELECT ds AS k, z, y, x, v FROM fx_fix"))
QUERIES["top_spots"] = lambda s, d: P.strongest(N.local_max(X.fix_blocks(s, d, BS)), 50).select(
    "ds", "z", "y", "x", F.col("v").cast("bigint").alias("v"), "rank")
ORACLES["top_spots"] = sql(
    "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ds ORDER BY v DESC, z, y, x) AS INT) AS rank FROM pk)"
    " WHERE rank <= 50", pk=_PEAK)
QUERIES["spots_image"] = lambda s, d: B.unpack(
    P.spots_image(X.points(s, d), X.DIMS, BS, ids=X.datasets(s, d))).withColumn("v", F.col("v").cast("bigint"))
ORACLES["spots_image"] = sql(
    "SELECT g.ds, g.z, g.y, g.x, coalesce(n, 0) AS v FROM fx_grid g LEFT JOIN (SELECT ds, CAST(floor(z) AS BIGINT) AS z,"
    " CAST(floor(y) AS BIGINT) AS y, CAST(floor(x) AS BIGINT) AS x, count(*) AS n FROM fx_points GROUP BY 1, 2, 3, 4) p"
    " USING (ds, z, y, x)")


def spots_radial(spark, sf):
    s = P.detect_radial(X.fix_blocks(spark, sf, BS), 60.0)
    return s.select("ds", "cz", "cy", "cx", F.col("v").cast("bigint").alias("v"), *[F.round(a, 4).alias(a) for a in "zyx"])


QUERIES["spots_radial"] = spots_radial



_G = "SELECT ds, z, y, x, " + ", ".join(
    f"(coalesce(lead(v) OVER w{a}, v) - coalesce(lag(v) OVER w{a}, v)) / 2e0 AS g{a}" for a in "zyx"
) + " FROM fx_fix WINDOW " + ", ".join(
    f"w{a} AS (PARTITION BY ds, {', '.join(b for b in 'zyx' if b != a)} ORDER BY {a})" for a in "zyx")
_W = {f"{i}{j}": f"({1 if i == j else 0} - g{i} * g{j} / n2)" for i in "zyx" for j in "zyx"}


def _det(m):
    return (f"({m[0][0]}*({m[1][1]}*{m[2][2]}-{m[1][2]}*{m[2][1]}) - {m[0][1]}*({m[1][0]}*{m[2][2]}-{m[1][2]}*{m[2][0]})"
            f" + {m[0][2]}*({m[1][0]}*{m[2][1]}-{m[1][1]}*{m[2][0]}))")


_MAT = [[f"m{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]


def _cramer(k):
    return _det([[f"b{i}" if j == k else _MAT[i][j] for j in range(3)] for i in range(3)])


ORACLES["spots_radial"] = sql(
    "SELECT ds, cz, cy, cx, v, " + ", ".join(
        f"round(c{a} + CASE WHEN abs({_det(_MAT)}) > 1e-9 THEN {_cramer(k)} / {_det(_MAT)} ELSE 0 END, 4) AS {a}" for k, a in enumerate("zyx"))
    + " FROM q",
    pk=_PEAK, g=_G, w="SELECT *, gz*gz + gy*gy + gx*gx AS n2 FROM g WHERE gz <> 0 OR gy <> 0 OR gx <> 0",
    q="SELECT p.ds, p.z AS cz, p.y AS cy, p.x AS cx, p.v, " + ", ".join(
        f"sum({_W['zyx'[i] + 'zyx'[j]]}) AS m{i}{j}" for i in range(3) for j in range(i, 3)) + ", " + ", ".join(
        f"sum({_W['zyx'[i] + 'z']}*(w.z-p.z) + {_W['zyx'[i] + 'y']}*(w.y-p.y) + {_W['zyx'[i] + 'x']}*(w.x-p.x)) AS b{i}" for i in range(3))
      + " FROM (SELECT * FROM pk, range(-1, 2) i(oz), range(-1, 2) j(oy), range(-1, 2) k(ox) WHERE v >= 60) p"
        " JOIN w ON w.ds = p.ds AND w.z = p.z + oz AND w.y = p.y + oy AND w.x = p.x + ox GROUP BY 1, 2, 3, 4, 5")
