"""Volumes, points, tiles and manifests derived from the given tables.

Every fixture grows with its table: the orders fill one dataset (image) per 3000
order keys, so more rows mean more images, and all operators run over all images
in one job.  `CTES` holds the same definitions as SQL for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.operators import blocks as B

DIMS = (7, 32, 32)
ORDERS_PER_DATASET = 3000
EVENTS_PER_DATASET = 2000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def _lines(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.expr(f"l_orderkey div {ORDERS_PER_DATASET}").alias("ds"),
        (F.col("l_linenumber") - 1).cast("bigint").alias("z"),
        (F.col("l_suppkey") % 32).alias("y"),
        (F.col("l_partkey") % 32).alias("x"),
        F.col("l_quantity").alias("q"),
        "l_shipdate",
        "l_returnflag",
    )


def datasets(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.expr(f"l_orderkey div {ORDERS_PER_DATASET}").alias("ds")).distinct()


def sparse(spark, sf) -> DataFrame:
    """Voxels that hold something: ds, z, y, x, v bigint."""
    return _lines(spark, sf).groupBy("ds", "z", "y", "x").agg(F.sum("q").cast("bigint").alias("v"))


def fix_blocks(spark, sf, bsize=(4, 8, 8)) -> DataFrame:
    return B.pack(sparse(spark, sf), DIMS, bsize, ids=datasets(spark, sf))


def fix(spark, sf) -> DataFrame:
    """Dense fixed volume, voxel view."""
    return B.unpack(fix_blocks(spark, sf, (7, 16, 16))).withColumn("v", F.col("v").cast("bigint"))


def _wrapped(df):
    return df.select("ds", "z", ((F.col("y") + 1) % 32).alias("y"), ((F.col("x") + 2) % 32).alias("x"),
                     (F.col("v") * 2 + 1).alias("v"))


def mov(spark, sf) -> DataFrame:
    """Moving volume: the fixed one wrapped by (0, 1, 2), intensity 2v + 1."""
    return _wrapped(fix(spark, sf))


def mov_blocks(spark, sf, bsize=(4, 8, 8)) -> DataFrame:
    return B.pack(_wrapped(sparse(spark, sf)), DIMS, bsize, fill=1, ids=datasets(spark, sf))


def tczyx(spark, sf) -> DataFrame:
    """Sparse five-dimensional volume."""
    li = _lines(spark, sf)
    return (
        li.groupBy(
            "ds",
            (F.year("l_shipdate") % 2).cast("bigint").alias("t"),
            F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
            .cast("bigint").alias("c"),
            "z", "y", "x",
        ).agg(F.sum("q").cast("bigint").alias("v"))
    )


def grid(spark, sf) -> DataFrame:
    """Coordinates of every voxel; datasets spread over the cluster before they expand."""
    out = B.block_skeleton(datasets(spark, sf), DIMS, (1, 32, 32)).repartition("ds", "blk_z")
    z = F.lit(0).cast("bigint")
    for a in ("y", "x"):
        out = out.withColumn(a, F.explode(F.sequence(z, F.lit(31).cast("bigint"))))
    return out.select("ds", F.col("blk_z").alias("z"), "y", "x")


def mask(spark, sf) -> DataFrame:
    """Disc mask of every dataset, full resolution."""
    inside = (F.col("y") - 16) * (F.col("y") - 16) + (F.col("x") - 16) * (F.col("x") - 16) <= 144
    return grid(spark, sf).withColumn("m", F.when(inside, 1).otherwise(0))


def low_mask(spark, sf) -> DataFrame:
    """Disc mask at a quarter of the in-plane resolution."""
    low = datasets(spark, sf)
    for a, n in zip("zyx", (7, 8, 8)):
        low = low.withColumn(a, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    inside = (F.col("y") - 4) * (F.col("y") - 4) + (F.col("x") - 4) * (F.col("x") - 4) <= 9
    return low.withColumn("m", F.when(inside, 1).otherwise(0))


AFFINE_COLS = [f"m{i}{j}" for i in range(3) for j in range(4)]


def affines(spark, sf) -> DataFrame:
    """Two affines per dataset (ds, seq, m array<double> of 12, row-major 3x4)."""
    shift = (F.col("ds") % 2) * 0.5
    first = [1.0, 0.0, 0.0, 0.25, 0.0, 1.0, 0.0, shift - 1.5, 0.0, 0.0, 1.0, 2.0]
    second = [1.0, 0.0, 0.0, 0.0, 0.0, 0.5, 0.25, 1.0, 0.0, -0.25, 0.5, 0.0]
    rows = F.array(
        *[F.struct(F.lit(i + 1).alias("seq"),
                   F.array(*[v if not isinstance(v, float) else F.lit(v) for v in m]).alias("m"))
          for i, m in enumerate((first, second))]
    )
    return datasets(spark, sf).select("ds", F.explode(rows).alias("a")).select("ds", "a.seq", "a.m")


def _disp_cols():
    return (
        F.lit(0.0).alias("dz"),
        (((F.col("y") + F.col("x") + F.col("ds")) % 3 - 1) * 0.5).alias("dy"),
        (((F.col("y") * F.col("x")) % 5 - 2) * 0.25).alias("dx"),
    )


def disp(spark, sf) -> DataFrame:
    """Displacement field, voxel view, values that are exact in binary."""
    return grid(spark, sf).select("ds", "z", "y", "x", *_disp_cols())


def disp_blocks(spark, sf, bsize=(4, 8, 8)) -> DataFrame:
    return B.pack(disp(spark, sf), DIMS, bsize, cols=("dz", "dy", "dx"), ids=datasets(spark, sf))


def prob(spark, sf) -> DataFrame:
    return fix(spark, sf).select("ds", "z", "y", "x", ((F.col("v") % 256) * 0.00390625).alias("p"))


def points(spark, sf) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.select(
        F.expr(f"event_id div {EVENTS_PER_DATASET}").alias("ds"),
        F.col("event_id").alias("point_id"),
        (F.col("event_id") % 3).alias("c"),
        ((F.col("event_id") % 25) * 0.25).alias("z"),
        ((F.col("user_id") % 124) * 0.25).alias("y"),
        (((F.col("event_id") * 7) % 124) * 0.25).alias("x"),
        F.col("value").alias("intensity"),
    )


def tiles(spark, sf) -> DataFrame:
    """3 x 4 overlapping tiles per dataset: true origin (oy, ox), stage error (jy, jx)."""
    ds = datasets(spark, sf)
    for a, n in (("a", 3), ("b", 4)):
        ds = ds.withColumn(a, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    a, b, d = F.col("a"), F.col("b"), F.col("ds")
    return ds.select(
        "ds", (a * 4 + b).alias("tile_id"), (a * 10).alias("oy"), (b * 7).alias("ox"),
        F.lit(12).cast("bigint").alias("h"), F.lit(11).cast("bigint").alias("w"),
        ((a * b + d) % 3 - 1).alias("jy"), ((a + b * 2 + d) % 3 - 1).alias("jx"),
    )


def tile_voxels(spark, sf) -> DataFrame:
    """Tile-local voxels.  A voxel finds its tiles by the tile grid (step 10, 7)."""
    y, x = F.col("y"), F.col("x")
    lo, zero = F.floor, F.lit(0).cast("bigint")
    f = fix(spark, sf)
    f = f.withColumn("a", F.explode(F.sequence(F.greatest(lo((y - 2) / 10), zero), F.least(lo(y / 10), F.lit(2).cast("bigint")))))
    f = f.withColumn("b", F.explode(F.sequence(F.greatest(lo((x - 4) / 7), zero), F.least(lo(x / 7), F.lit(3).cast("bigint")))))
    f = f.select("ds", (F.col("a") * 4 + F.col("b")).alias("tile_id"), "z",
                 (y - F.col("a") * 10).alias("y"), (x - F.col("b") * 7).alias("x"), "v")
    return f.where("y >= 0 and y < 12 and x >= 0 and x < 11")


def manifest(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(
        F.concat(F.lit("s"), F.col("c_custkey")).alias("meta_id"),
        F.concat(F.lit("/data/"), "c_mktsegment", F.lit("/r"), F.col("c_nationkey"), F.lit("/fix.n5")).alias("fix"),
        F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("c"), F.col("c_custkey") % 4, F.lit("/s5")))
        .alias("fix_subpath"),
        F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("mask"), F.col("c_custkey") % 7, F.lit(".nrrd")))
        .alias("fix_mask"),
        (F.col("c_custkey") % 4).alias("n_extra"),
        (F.col("c_acctbal") > 0).alias("use_mask"),
    )


def results(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.concat(F.lit("s"), F.col("o_custkey")).alias("meta_id"),
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("/out/"), "o_orderstatus", F.lit("/"), F.col("o_orderkey"), F.lit(".affine.mat")).alias("path"),
    )


def versions(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    k = F.col("p_partkey") % 4
    return p.select(
        F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("process"), F.col("p_type").alias("tool"),
        F.when(k == 0, F.concat(F.col("p_size"), F.lit(".1.0"))).when(k == 1, "dev")
        .when(k == 2, "199cd91199cd91199cd91199cd91199cd91199cda").otherwise("END_VERSIONS").alias("version"),
    )


#: SQL definitions of the fixtures, in dependency order.
CTES = {
    "fx_ds": "SELECT DISTINCT l_orderkey // 3000 AS ds FROM lineitem",
    "fx_grid": "SELECT ds, CAST(z AS BIGINT) AS z, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x"
               " FROM fx_ds, range(7) a(z), range(32) b(y), range(32) c(x)",
    "fx_sparse": "SELECT l_orderkey // 3000 AS ds, CAST(l_linenumber - 1 AS BIGINT) AS z, l_suppkey % 32 AS y,"
                 " l_partkey % 32 AS x, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2, 3, 4",
    "fx_fix": "SELECT g.ds, g.z, g.y, g.x, coalesce(s.v, 0) AS v FROM fx_grid g LEFT JOIN fx_sparse s"
              " ON g.ds = s.ds AND g.z = s.z AND g.y = s.y AND g.x = s.x",
    "fx_mov": "SELECT ds, z, (y + 1) % 32 AS y, (x + 2) % 32 AS x, v * 2 + 1 AS v FROM fx_fix",
    "fx_tczyx": "SELECT l_orderkey // 3000 AS ds, CAST(year(l_shipdate) % 2 AS BIGINT) AS t,"
                " CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS BIGINT) AS c,"
                " CAST(l_linenumber - 1 AS BIGINT) AS z, l_suppkey % 32 AS y, l_partkey % 32 AS x,"
                " CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2, 3, 4, 5, 6",
    "fx_mask": "SELECT ds, z, y, x, CASE WHEN (y-16)*(y-16)+(x-16)*(x-16) <= 144 THEN 1 ELSE 0 END AS m FROM fx_grid",
    "fx_lowmask": "SELECT ds, z, y, x, CASE WHEN (y-4)*(y-4)+(x-4)*(x-4) <= 9 THEN 1 ELSE 0 END AS m"
                  " FROM fx_grid WHERE y < 8 AND x < 8",
    "fx_affine": "SELECT ds, seq, m00, m01, m02, m03, m10, m11, m12, m13 + CASE WHEN seq = 1 THEN (ds % 2) * 0.5e0"
                 " ELSE 0e0 END AS m13, m20, m21, m22, m23 FROM fx_ds, (VALUES"
                 " (1, 1e0,0e0,0e0,0.25e0, 0e0,1e0,0e0,-1.5e0, 0e0,0e0,1e0,2e0),"
                 " (2, 1e0,0e0,0e0,0e0, 0e0,0.5e0,0.25e0,1e0, 0e0,-0.25e0,0.5e0,0e0))"
                 " AS t(seq,m00,m01,m02,m03,m10,m11,m12,m13,m20,m21,m22,m23)",
    "fx_disp": "SELECT ds, z, y, x, 0e0 AS dz, ((y + x + ds) % 3 - 1) * 0.5e0 AS dy,"
               " ((y * x) % 5 - 2) * 0.25e0 AS dx FROM fx_grid",
    "fx_prob": "SELECT ds, z, y, x, (v % 256) * 0.00390625e0 AS p FROM fx_fix",
    "fx_points": "SELECT event_id // 2000 AS ds, event_id AS point_id, event_id % 3 AS c, (event_id % 25)*0.25e0 AS z,"
                 " (user_id % 124)*0.25e0 AS y, ((event_id*7) % 124)*0.25e0 AS x, value AS intensity FROM events",
    "fx_tiles": "SELECT ds, CAST(a*4+b AS BIGINT) AS tile_id, CAST(a*10 AS BIGINT) AS oy, CAST(b*7 AS BIGINT) AS ox,"
                " CAST(12 AS BIGINT) AS h, CAST(11 AS BIGINT) AS w, CAST((a*b+ds) % 3 - 1 AS BIGINT) AS jy,"
                " CAST((a+2*b+ds) % 3 - 1 AS BIGINT) AS jx FROM fx_ds, range(3) p(a), range(4) q(b)",
    "fx_tile_voxels": "SELECT t.ds, t.tile_id, f.z, f.y - t.oy AS y, f.x - t.ox AS x, f.v FROM fx_tiles t JOIN fx_fix f"
                      " ON f.ds = t.ds AND f.y >= t.oy AND f.y < t.oy+t.h AND f.x >= t.ox AND f.x < t.ox+t.w",
    "fx_manifest": "SELECT concat('s', c_custkey) AS meta_id, concat('/data/', c_mktsegment, '/r', c_nationkey,"
                   " '/fix.n5') AS fix, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('c', c_custkey % 4, '/s5') END"
                   " AS fix_subpath, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('mask', c_custkey % 7, '.nrrd')"
                   " END AS fix_mask, c_custkey % 4 AS n_extra, c_acctbal > 0 AS use_mask FROM customer",
    "fx_results": "SELECT concat('s', o_custkey) AS meta_id, o_orderkey AS seq, concat('/out/', o_orderstatus, '/',"
                  " o_orderkey, '.affine.mat') AS path FROM orders",
    "fx_versions": "SELECT p_partkey AS row_id, p_brand AS process, p_type AS tool, CASE p_partkey % 4"
                   " WHEN 0 THEN concat(p_size, '.1.0') WHEN 1 THEN 'dev'"
                   " WHEN 2 THEN '199cd91199cd91199cd91199cd91199cd91199cda' ELSE 'END_VERSIONS' END AS version FROM part",
}


def sql(body: str, **ctes: str) -> str:
    """`body` with the fixtures it names (and `ctes`, in order) as a WITH clause."""
    import re

    needed: list[str] = []

    def visit(text):
        for name in CTES:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(CTES[name])
                needed.append(name)

    for text in [*ctes.values(), body]:
        visit(text)
    parts = [f"{n} AS ({CTES[n]})" for n in needed]
    for n, t in ctes.items():
        kept = "" if re.search(rf"\bJOIN {n}\b|\bFROM {n}\b", t) else "MATERIALIZED "  # not for recursive ones
        parts.append(f"{n} AS {kept}({t})")
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
