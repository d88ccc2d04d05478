"""Queries: sources, sinks, named jobs, streaming.  Each writes under the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.functions import paths as L
from voxelloom.operators import blocks as B
from voxelloom.operators import fields as D
from voxelloom.operators import pyramid as P
from voxelloom.operators import register as R
from voxelloom.plans import fixture_files as FF
from voxelloom.plans import fixtures as X
from voxelloom.plans.fixtures import sql
from voxelloom.plans.q_select import ORACLES as SEL
from voxelloom.plans.q_select import _L1, r6
from voxelloom.plans.registry import run_op
from voxelloom.session import scratch_path
from voxelloom.sources import chunked as C
from voxelloom.sources import container as N
from voxelloom.sources import images as I
from voxelloom.sources import tables as T
from voxelloom.streaming import grouping

QUERIES, ORACLES = {}, {}
BS = (4, 16, 16)


def _number(col):
    return F.regexp_extract(col, r"d(\d+)", 1).cast("bigint").alias("ds")


def _voxels(blocks, col="v"):
    vox = B.unpack(blocks, (col,), keys=("folder",))
    return vox.select(_number("folder"), "z", "y", "x", F.col(col).cast("bigint").alias("v"))


def src_chunked(spark, sf):
    """The fixed volumes through N5 (gzip and raw) and Zarr (zlib), read by subpath."""
    blocks, out = X.fix_blocks(spark, sf, BS), None
    for fmt, codec in (("n5", "gzip"), ("n5", "raw"), ("zarr", "zlib")):
        root = scratch_path(spark, f"src_chunked_{fmt}")
        C.write(blocks, root, F.concat(F.lit("d"), "ds", F.lit(f".{fmt}/c0/s0")), fmt, "uint16", codec)
        part = _voxels(C.read(spark, root, fmt, "c0/s0")).withColumn("kind", F.lit(f"{fmt}-{codec}"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES["src_chunked"] = src_chunked
ORACLES["src_chunked"] = sql("SELECT f.*, kind FROM fx_fix f, (VALUES ('n5-gzip'), ('n5-raw'), ('zarr-zlib')) t(kind)")


def src_nd(spark, sf):
    """Five-dimensional images through N5 and Zarr, two channels of one time by filters that the source takes."""
    vox, out = X.tczyx(spark, sf), None
    blocks = B.pack(vox, X.DIMS, BS, keys=("ds", "t", "c"))
    for fmt, codec in (("n5", "gzip"), ("zarr", "zlib")):
        root = scratch_path(spark, f"src_nd_{fmt}")
        C.write(blocks, root, F.concat(F.lit("d"), "ds", F.lit(".img/s0")), fmt, "uint16", codec, lead=("t", "c"))
        found = N.read(spark, root, fmt).where((F.col("t") == 1) & F.col("c").isin(0, 2) & F.col("folder").endswith("/s0"))
        part = B.unpack(found, keys=("folder", "t", "c")).where("v <> 0").select(
            _number("folder"), "t", "c", "z", "y", "x", F.col("v").cast("bigint").alias("v"), F.lit(fmt).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES["src_nd"] = src_nd
ORACLES["src_nd"] = sql("SELECT f.*, kind FROM fx_tczyx f, (VALUES ('n5'), ('zarr')) k(kind) WHERE t = 1 AND c IN (0, 2)")


def sink_multiscale(spark, sf):
    """Pyramids of three levels in containers, blocks of one size, all levels read back from there."""
    out = None
    for fmt in ("n5", "zarr"):
        root = scratch_path(spark, f"multiscale_{fmt}")
        N.write_pyramid(X.fix_blocks(spark, sf, (4, 8, 8)), root, F.concat(F.lit("d"), "ds", F.lit(".img")), 2, fmt, "float64", "zlib")
        vox = B.unpack(N.read(spark, root, fmt), keys=("folder",))
        part = vox.select(_number("folder"), F.regexp_extract("folder", r"/s(\d+)$", 1).cast("int").alias("scale"), "z", "y", "x", r6("v").alias("v"),
                          F.lit(fmt).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES["sink_multiscale"] = sink_multiscale
ORACLES["sink_multiscale"] = sql(
    "SELECT f.*, kind FROM (SELECT ds, 0 AS scale, z, y, x, CAST(v AS DOUBLE) AS v FROM fx_fix UNION ALL SELECT ds, 1, z, y, x, round(v, 6) FROM l1"
    " UNION ALL SELECT ds, 2, z, y, x, round(v, 6) FROM l2) f, (VALUES ('n5'), ('zarr')) k(kind)", l1=_L1.format("fx_fix"), l2=_L1.format("l1"))


def _tiffs(spark, sf, deflate):
    root = scratch_path(spark, "tiff")
    vox = X.tczyx(spark, sf).groupBy("ds", "c", "z", "y", "x").agg(F.sum("v").alias("v"))
    blocks = B.pack(vox, X.DIMS, BS, keys=("ds", "c"))
    FF.write_tiff(blocks, root, F.concat(F.lit("d"), "ds"), deflate=deflate)
    return root


def src_ingest(spark, sf):
    """TIFF stacks -> one Zarr container per file, then read back."""
    root = scratch_path(spark, "ingest")
    I.ingest_tiff(spark, f"{_tiffs(spark, sf, True)}/*.tif", root, BS)
    vox = B.unpack(C.read(spark, root, "zarr"), keys=("folder",))
    return vox.select(_number("folder"), F.regexp_extract("folder", r"/c(\d+)/", 1).cast("bigint").alias("c"), "z", "y", "x",
                      F.col("v").cast("bigint").alias("v"))


_CH = ("SELECT g.ds, t.c, g.z, g.y, g.x, CAST(coalesce(sum(s.v), 0) AS BIGINT) AS v FROM fx_grid g CROSS JOIN range(3) t(c) LEFT JOIN"
       " fx_tczyx s ON g.ds = s.ds AND t.c = s.c AND g.z = s.z AND g.y = s.y AND g.x = s.x GROUP BY 1, 2, 3, 4, 5")
QUERIES["src_ingest"] = src_ingest
ORACLES["src_ingest"] = sql(_CH)


def src_tiff_channels(spark, sf):
    """Stacks split by channel and cut to blocks: every voxel."""
    planes = I.read_tiff(spark, f"{_tiffs(spark, sf, False)}/*.tif")
    blocks = B.rechunk(planes, BS, keys=("image", "c"))
    return B.unpack(blocks, keys=("image", "c")).select("image", "c", "z", "y", "x", F.col("v").cast("bigint").alias("v"))


QUERIES["src_tiff_channels"] = src_tiff_channels
ORACLES["src_tiff_channels"] = sql("SELECT concat('d', ds) AS image, c, z, y, x, v FROM ch", ch=_CH)


def src_mask(spark, sf):
    root = scratch_path(spark, "mask")
    FF.write_nrrd(X.mask(spark, sf), root, F.concat(F.lit("d"), "ds"))
    vox = B.unpack(I.read_nrrd(spark, f"{root}/*.nrrd"), keys=("image",))
    return vox.select(_number("image"), "z", "y", "x", F.col("v").cast("int").alias("m"))


QUERIES["src_mask"] = src_mask
ORACLES["src_mask"] = sql("SELECT * FROM fx_mask")


def field_io(spark, sf):
    """Displacement field as a vector dataset of an N5 container."""
    root = scratch_path(spark, "field")
    C.write(X.disp_blocks(spark, sf, BS), root, F.concat(F.lit("d"), "ds", F.lit("-deform.n5/s0")), "n5", "float64", "gzip", D.COMPONENTS)
    vox = B.unpack(C.read(spark, root, "n5", cols=D.COMPONENTS), D.COMPONENTS, keys=("folder",))
    return vox.select(_number("folder"), "z", "y", "x", *[(F.col(c) + F.lit(0.0)).alias(c) for c in D.COMPONENTS])


QUERIES["field_io"] = field_io
ORACLES["field_io"] = sql("SELECT ds, z, y, x, dz, dy + 0e0 AS dy, dx + 0e0 AS dx FROM fx_disp")


def points_csv(spark, sf):
    """Points written as CSV below the sample's default name, and read back."""
    p = X.points(spark, sf)
    named = p.withColumn("name", L.points_name(F.lit(""), F.concat(F.lit("d"), "ds")))
    root = scratch_path(spark, "points")
    T.write_points(named, root, ("ds", "name"))
    return T.read_points(spark, root, "ds bigint, name string").select("ds", "name", "point_id", "c", "z", "y", "x", "intensity")


QUERIES["points_csv"] = points_csv
ORACLES["points_csv"] = sql("SELECT *, concat('d', ds, '-points.csv') AS name FROM fx_points")


def affine_io(spark, sf):
    root = scratch_path(spark, "affine")
    T.write_affines(X.affines(spark, sf), root)
    a = T.read_affines(spark, root)
    return a.select(F.col("ds").cast("bigint").alias("ds"), F.col("seq").cast("int").alias("seq"),
                    *[F.col("m")[i].alias(f"m{i // 4}{i % 4}") for i in range(12)])


QUERIES["affine_io"] = affine_io
ORACLES["affine_io"] = sql("SELECT * FROM fx_affine")


def sink_blocks(spark, sf):
    """Pyramid blocks stored by channel and scale; every voxel of scale 0 and the sum of scale 1, from the stored table."""
    vox = X.tczyx(spark, sf).groupBy("ds", "c", "z", "y", "x").agg(F.sum("v").alias("v"))
    blocks = P.full(B.pack(vox, X.DIMS, (8, 16, 16), keys=("ds", "c")), 1, keys=("ds", "c"))
    path = scratch_path(spark, "blocks")
    T.write_blocks(blocks, path)
    stored = spark.read.parquet(path).withColumns({"c": F.col("c").cast("bigint")})
    coarse = B.volume_checks(stored.where("scale = 1"), keys=("ds", "c")).groupBy("ds", "c").agg(F.round(F.sum("total"), 3).alias("total1"))
    full = B.unpack(stored.where("scale = 0"), keys=("ds", "c")).select("ds", "c", "z", "y", "x", F.col("v").cast("bigint").alias("v"))
    return full.join(coarse, ["ds", "c"])


QUERIES["sink_blocks"] = sink_blocks
ORACLES["sink_blocks"] = sql(
    "SELECT ch.*, total1 FROM ch JOIN t USING (ds, c)", ch=_CH,
    l="SELECT ds, c, avg(v) AS a FROM ch GROUP BY ds, c, z // 2, y // 2, x // 2",
    t="SELECT ds, c, round(sum(a), 3) + 0e0 AS total1 FROM l GROUP BY ds, c")


def sink_slot(spark, sf):
    """Overwrite slot (t, c) = (0, 1) of a stored volume."""
    vol, path = X.tczyx(spark, sf), scratch_path(spark, "slot")
    T.write_slot(vol, path)
    T.write_slot(vol.where("t = 0 and c = 1").withColumn("v", F.col("v") * 10), path)
    return spark.read.parquet(path).select("ds", F.col("t").cast("bigint").alias("t"), F.col("c").cast("bigint").alias("c"), "z", "y", "x", "v")


QUERIES["sink_slot"] = sink_slot
ORACLES["sink_slot"] = sql("SELECT ds, t, c, z, y, x, CASE WHEN t = 0 AND c = 1 THEN v * 10 ELSE v END AS v FROM fx_tczyx")
QUERIES["list_outputs"] = lambda s, d: X.results(s, d).where(T.matches_output(F.col("path"), "1", "mat"))
ORACLES["list_outputs"] = sql("SELECT * FROM fx_results WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '^1.*[.]mat$')")


def reuse_transform(spark, sf):
    """The second request finds the stored transform and does not compute."""
    path = scratch_path(spark, "transform")

    def never():
        raise AssertionError("a stored transform was computed again")

    T.reuse(spark, path, lambda: R.centres(X.fix(spark, sf), X.mov(spark, sf)))
    return T.reuse(spark, path, never).select("ds", *[r6(F.col("m")[i]).alias(f"m{i // 4}{i % 4}") for i in range(12)])


QUERIES["reuse_transform"] = reuse_transform
_MEANS = {side: ", ".join(f"sum(v*{a})/sum(v)::DOUBLE AS {side}{a}" for a in "zyx") for side in "fm"}
ORACLES["reuse_transform"] = sql(
    "SELECT ds, " + ", ".join(
        f"{1 if i == j else 0}::DOUBLE AS m{i}{j}" if j < 3 else f"round(m{'zyx'[i]} - f{'zyx'[i]}, 6) + 0e0 AS m{i}3"
        for i in range(3) for j in range(4)) + " FROM f JOIN m USING (ds)",
    f=f"SELECT ds, {_MEANS['f']} FROM fx_fix GROUP BY ds", m=f"SELECT ds, {_MEANS['m']} FROM fx_mov GROUP BY ds")
QUERIES["udf_job"] = lambda s, d: run_op("pyramid.level", [X.fix(s, d)], {"factor": (2, 2, 2)}).withColumn("v", r6("v"))
ORACLES["udf_job"] = SEL["pyramid_level"]


def stream_group_size(spark, sf):
    """Groups of five events per user in arrival order, from a file stream."""
    schema = X.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = grouping.run_available(spark, grouping.fixed_groups(stream, "user_id", "event_id", 5), "stream_groups")
    return out.select("user_id", "grp", "n", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


QUERIES["stream_group_size"] = stream_group_size
ORACLES["stream_group_size"] = (
    "SELECT user_id, CAST((rn - 1) // 5 AS BIGINT) AS grp, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY rn) AS members"
    " FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)"
    " GROUP BY 1, 2 HAVING count(*) = 5"
)
