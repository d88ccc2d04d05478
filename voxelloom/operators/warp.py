"""Resampling: warped volumes, points looked up in fields, coordinate transforms.

A warp is a gather: from the bounds of where a target block samples, the source
blocks it needs are known; target blocks and source blocks are joined, cut to the needed
boxes, and the boxes are brought to the target block.  Voxels are never shuffled one by one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.functions import affine as A
from voxelloom.operators import blocks as B


def trilinear(a: np.ndarray, lo, pos) -> np.ndarray:
    """Values at index positions `pos` (z, y, x arrays) of an array that starts at
    `lo`; corners outside the array count as 0."""
    a = np.pad(a, 1)
    base = [np.floor(p).astype(np.int64) for p in pos]
    frac = [p - b for p, b in zip(pos, base)]
    weight = [(1.0 - f, f) for f in frac]
    step = (a.shape[1] * a.shape[2], a.shape[2], 1)
    at = [[np.clip(b + (d - q + 1), 0, n - 1) * s for d in (0, 1)] for b, q, n, s in zip(base, lo, a.shape, step)]
    a, out = a.ravel(), 0.0
    for dz in (0, 1):
        for dy in (0, 1):
            w, line = weight[0][dz] * weight[1][dy], at[0][dz] + at[1][dy]
            for dx in (0, 1):
                out = out + w * weight[2][dx] * a[line + at[2][dx]]
    return out


def block_positions(row) -> list[np.ndarray]:
    """Index coordinates of a block's voxels as three broadcastable arrays."""
    org, core = B.core_origin(row), B.core_shape(row)
    return np.meshgrid(*[np.arange(o, o + c, dtype=float) for o, c in zip(org, core)], indexing="ij")


def with_grid(blocks: DataFrame, grid: DataFrame, keys=("ds",)) -> DataFrame:
    """Attach one small row per key (e.g. the affine `m`) to every block."""
    return blocks.join(grid, list(keys))


def field_ends(field) -> dict[str, Column]:
    """Columns for `ends` of `warp`."""
    return {f"_{end}{i}": f(c) for i, c in enumerate(field) for end, f in (("least", F.array_min), ("most", F.array_max))}


def warp(target: DataFrame, source: DataFrame, src_dims, src_bsize, keys=("ds",), cols=("v",), field=None,
         affine: str | None = "m", spacing=(1.0, 1.0, 1.0), src_spacing=(1.0, 1.0, 1.0), displacement=False, ends=None) -> DataFrame:
    """out(x) = source(A(x + d(x))), trilinear, 0 outside; a block table like `target`.

    `target` is a block table: its columns may hold the affine (`affine`) and three
    displacement arrays (`field`), both in physical units.  With `displacement` the
    sampled vectors get the movement A(x + d(x)) - x added, which composes fields.
    `ends`: names of columns of a stored `target` with the least and greatest value of each displacement array (`field_ends`);
    without them Spark looks through the arrays anew for every condition on the box.
    """
    m = F.col(affine) if affine else A.identity()
    lo, hi = [], []
    for i, b in enumerate(B.BLK):
        first = F.col(b) * F.col("bsize")[i]
        last = F.least(first + F.col("bsize")[i], F.col("dims")[i]) - 1
        add = (F.lit(0.0), F.lit(0.0))
        if field:
            add = [F.col(c) for c in ends[2 * i:2 * i + 2]] if ends else (F.array_min(field[i]), F.array_max(field[i]))
        lo.append(first * float(spacing[i]) + add[0])
        hi.append(last * float(spacing[i]) + add[1])
    need = {}
    for i in range(3):
        low = high = m[4 * i + 3]
        for j in range(3):
            p, q = m[4 * i + j] * lo[j], m[4 * i + j] * hi[j]
            low, high = low + F.least(p, q), high + F.greatest(p, q)
        need[f"_n{i}"] = F.greatest(F.floor(low / float(src_spacing[i]) - 1e-6), F.lit(0).cast("bigint"))
        need[f"_m{i}"] = F.least(F.floor(high / float(src_spacing[i]) + 1e-6) + 2, F.lit(int(src_dims[i])).cast("bigint"))
    target = target.withColumns(need)
    box = [f"_n{i}" for i in range(3)] + [f"_m{i}" for i in range(3)]
    wanted = target.select(*keys, *[F.col(b).alias(f"_t{b}") for b in B.BLK], *box)
    wanted = wanted.where(" and ".join(f"_m{i} > _n{i}" for i in range(3)))
    for i, b in enumerate(B.BLK):
        s = int(src_bsize[i])
        wanted = wanted.withColumn(b, F.explode(F.sequence(F.floor(F.col(f"_n{i}") / s), F.floor((F.col(f"_m{i}") - 1) / s))))
    src = source.select(*keys, *B.BLK, *cols)
    got = wanted.join(B.never_broadcast(src), [*keys, *B.BLK])
    for i, b in enumerate(B.BLK):
        s, d = int(src_bsize[i]), int(src_dims[i])
        got = got.withColumns({f"_a{i}": F.col(b) * s, f"_b{i}": F.least(F.col(b) * s + s, F.lit(d).cast("bigint"))})
        got = got.withColumns({f"_lo{i}": F.greatest(f"_n{i}", f"_a{i}"), f"_hi{i}": F.least(f"_m{i}", f"_b{i}")})
    part = F.array(*[F.col(f"_lo{i}") for i in range(3)], *[F.col(f"_hi{i}") - F.col(f"_lo{i}") for i in range(3)])
    parts = got.select(*keys, *[F.col(f"_t{b}").alias(b) for b in B.BLK],
                       F.struct(part.alias("box"), *[B.slab(c).alias(c) for c in cols]).alias("p"))
    parts = parts.groupBy(*keys, *B.BLK).agg(F.collect_list("p").alias("p"))
    parts = parts.select(*keys, *B.BLK, F.flatten("p.box").alias("part_box"),
                         *[F.flatten(f"p.{c}").alias(f"part_{c}") for c in cols])
    keep = [*keys, *B.BLK, "dims", "bsize"]
    moved = ["_move_z", "_move_y", "_move_x"] if field else []
    side = target.select(*keep, *box, m.alias("_m"), *[F.col(f).alias(n) for f, n in zip(field or (), moved)])
    both = side.join(B.never_broadcast(parts), [*keys, *B.BLK], "left")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in target.select(*keep).schema)
    schema += "".join(f", {c} array<double>" for c in cols)

    def run(batches):
        for pdf in B.pieces(batches, B.block_bytes(len(cols))):
            pdf = pdf.rename(columns={c: c.lstrip("_") for c in pdf.columns})
            made = {c: [] for c in cols}
            for row in pdf.itertuples(index=False):
                x = [g * s for g, s in zip(block_positions(row), spacing)]
                p = x
                if field:
                    shape = p[0].shape
                    p = [g + np.asarray(d, dtype=float).reshape(shape) for g, d in zip(p, (row.move_z, row.move_y, row.move_x))]
                a = np.asarray(row.m, dtype=float).reshape(3, 4)
                p = [a[i, 0] * p[0] + a[i, 1] * p[1] + a[i, 2] * p[2] + a[i, 3] for i in range(3)]
                at = [q / s for q, s in zip(p, src_spacing)]
                low = [row.n0, row.n1, row.n2]
                size = [max(h - q, 0) for q, h in zip(low, (row.m0, row.m1, row.m2))]
                for i, c in enumerate(cols):
                    data = getattr(row, f"part_{c}")
                    if data is None or not min(size):
                        v = np.zeros(x[0].shape)
                    else:
                        v = trilinear(_paste(size, low, row.part_box, data), low, at)
                    if displacement:
                        v = v + p[i] - x[i]
                    made[c].append(v.ravel())
            yield pdf[keep].assign(**made)

    return both.mapInPandas(run, schema)


def _paste(size, low, boxes, data) -> np.ndarray:
    out, at, data = np.zeros(size), 0, np.asarray(data)
    for box in np.asarray(boxes).reshape(-1, 6):
        s, n = box[:3] - low, box[3:]
        count = int(np.prod(n))
        out[s[0]:s[0] + n[0], s[1]:s[1] + n[1], s[2]:s[2] + n[2]] = data[at:at + count].reshape(n)
        at += count
    return out


def salted(df: DataFrame, keys, id_col: str, chunk: int, name: str = "salt") -> DataFrame:
    """Split groups of more than `chunk` rows: a salt from the row's id."""
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > int(chunk))
    hot = hot.select(*keys, F.ceil(F.col("_n") / int(chunk)).alias("_parts"))
    salt = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(id_col), "_parts")).otherwise(F.lit(0).cast("bigint"))
    return df.join(hot, list(keys), "left").withColumn(name, salt).drop("_parts")


def sample_points(points: DataFrame, source: DataFrame, keys=("ds",), cols=("v",), id_col="point_id",
                  pos=("z", "y", "x"), src_bsize=(4, 8, 8), chunk: int = 20000) -> DataFrame:
    """Trilinear values of a block table at point positions (index units), 0 outside.

    Points meet the block that holds their lower corner, with a halo of one voxel.
    A block that attracts very many points is replicated to several salted groups.
    Output: keys, id_col, sampled columns.
    """
    at = points.select(
        *keys, id_col, *[F.col(p).cast("double").alias(f"_p{i}") for i, p in enumerate(pos)],
        *[F.floor(F.floor(F.col(p)) / int(s)).cast("bigint").alias(b) for p, b, s in zip(pos, B.BLK, src_bsize)],
    )
    # One block beyond the lower border still reaches the first voxel layer.
    at = at.withColumns({b: F.greatest(F.col(b), F.lit(0).cast("bigint")) for b in B.BLK})
    on = [*keys, *B.BLK]
    at = salted(at, on, id_col, chunk)
    groups = at.groupBy(*on, "salt").agg(F.collect_list(F.struct(id_col, "_p0", "_p1", "_p2")).alias("q"))
    groups = groups.select(*on, F.col(f"q.{id_col}").alias("ids"), *[F.col(f"q._p{i}").alias(f"p{i}") for i in range(3)])
    near = B.exchange(source, (1, 1, 1), cols, keys)
    both = groups.join(B.never_broadcast(near), on, "left")
    id_type = points.schema[id_col].dataType.simpleString()
    keep = list(keys)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.select(*keys).schema)
    schema += f", {id_col} {id_type}" + "".join(f", {c} double" for c in cols)

    def made(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                out = {id_col: row.ids}
                p = [np.asarray(v, dtype=float) for v in (row.p0, row.p1, row.p2)]
                inside = row.part_box is not None
                if inside:
                    low = [o - 1 for o in B.core_origin(row)]
                for c in cols:
                    out[c] = trilinear(B.assemble(row, c, (1, 1, 1), "constant"), low, p) if inside else np.zeros(len(p[0]))
                yield [getattr(row, k) for k in keep], out

    def run(batches):
        return B.together(made(batches), [id_col, *cols], keep)

    return both.mapInPandas(run, schema)


def transform_coords(points: DataFrame, affine: DataFrame | None = None, field: DataFrame | None = None,
                     resolution=(1.0, 1.0, 1.0), downsampling=(1.0, 1.0, 1.0), keys=("ds",), id_col="point_id",
                     field_spacing=(1.0, 1.0, 1.0), field_bsize=(4, 8, 8)) -> DataFrame:
    """Move point sets: pixel -> physical, then the affine of each key, then the
    displacement found at the moved position.  Absent parts are not planned."""
    from voxelloom.operators.select import AXES, scale_coords

    df = scale_coords(points, resolution, downsampling)
    if affine is not None:
        df = df.join(affine.select(*keys, F.col("m").alias("_m")), list(keys))
        moved = A.apply(F.col("_m"), [F.col(a) for a in AXES])
        df = df.withColumns(dict(zip(AXES, moved))).drop("_m")
    if field is not None:
        # whole rows travel with the points: ids may repeat, and nothing is joined back
        at = df.select(*keys, F.struct(*df.columns).alias("_row"), *[(F.col(a) / float(s)).alias(a) for a, s in zip(AXES, field_spacing)])
        d = sample_points(at, field, keys, ("dz", "dy", "dx"), "_row", AXES, field_bsize)
        df = d.select(*[(F.col(f"_row.{c}") + F.col(f"d{c}") if c in AXES else F.col(f"_row.{c}")).alias(c) for c in df.columns])
    return df
