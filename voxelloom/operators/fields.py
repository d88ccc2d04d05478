"""Displacement fields: inversion, composition, splines, blending of block transforms."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators import blocks as B
from voxelloom.operators import filters as N
from voxelloom.operators.warp import block_positions, trilinear, warp
from voxelloom.session import cut

COMPONENTS = ("dz", "dy", "dx")


def reach(field: DataFrame, cols=COMPONENTS) -> list[int]:
    """Largest displacement per axis in whole voxels (one aggregate, three numbers)."""
    worst = [F.max(F.greatest(F.abs(F.array_max(c)), F.abs(F.array_min(c)))) for c in cols]
    return [math.ceil(v or 0.0) for v in field.agg(*worst).first()]


def _root(d, low, pos, iterations):
    """Field r with r(x) + r(x + r(x)) near d(x), on the whole padded array."""
    r = [0.5 * c for c in d]
    for _ in range(iterations):
        at = [p + c for p, c in zip(pos, r)]
        twice = [c + trilinear(c, low, at) for c in r]
        r = [c + 0.5 * (t - w) for c, t, w in zip(r, d, twice)]
    return r


def invert(field: DataFrame, iterations=10, step: float = 1.0, smooth=0.0, use_root: bool = False,
           sqrt_iterations: int = 10, keys=("ds",), max_reach=None) -> DataFrame:
    """Inverse field u by the fixed point u <- u + step * (-d(x + u) - u), from u = 0.

    |u| never exceeds the largest |d|, so a halo of that many voxels lets every block
    run all its iterations alone: one shuffle in total.  `iterations` may be a list of
    levels; `smooth` (a number or one sigma per level) smooths the field of a level.
    `use_root` inverts the square-root field and applies that inverse twice.
    Displacements are in voxels.
    """
    levels = list(iterations) if isinstance(iterations, (list, tuple)) else [iterations]
    sigmas = list(smooth) if isinstance(smooth, (list, tuple)) else [smooth] * len(levels)
    if len(sigmas) != len(levels):
        raise ValueError("one smoothing sigma per level")
    if max_reach is None:
        field = cut(field)  # read twice: for its reach and for the inversion
        max_reach = reach(field)
    far = [r + 1 for r in max_reach]
    soft = max(N.radius(s) for s in sigmas)
    rounds = sum(levels) + sqrt_iterations + 2 if use_root else 1
    halo = [f * rounds + soft for f in far]

    def kernel(arrays, row):
        core = B.core_shape(row)
        org = B.core_origin(row)
        inner = [h - soft for h in halo]
        low = [o - i for o, i in zip(org, inner)]
        if use_root:
            pos = np.meshgrid(*[np.arange(q, q + c + 2 * i, dtype=float) for q, c, i in zip(low, core, inner)], indexing="ij")
        else:
            pos = block_positions(row)
        u = [np.zeros(pos[0].shape) for _ in range(3)]
        for n, sigma in zip(levels, sigmas):
            cut = [soft - N.radius(sigma)] * 3
            d = [N.smooth_array(N.trim(a, cut), [sigma] * 3) for a in arrays]
            if use_root:
                d = _root(d, low, pos, sqrt_iterations)
            for _ in range(n):
                at = [p + c for p, c in zip(pos, u)]
                u = [c + step * (-trilinear(k, low, at) - c) for c, k in zip(u, d)]
        if use_root:
            at = [p + c for p, c in zip(pos, u)]
            u = [N.trim(c + trilinear(c, low, at), inner) for c in u]
        return u

    parts = B.exchange(field, halo, COMPONENTS, keys)
    return B.map_blocks(parts, kernel, halo, COMPONENTS, [(c, "double") for c in COMPONENTS], keys, pad="constant")


def compose(first: DataFrame, second: DataFrame, dims, bsize, affine: str | None = None, keys=("ds",)) -> DataFrame:
    """One field for x -> y = A(x + first(x)) -> y + second(y); either may be absent.

    `first` is the block table of the target grid (with the affine column, and field
    arrays unless it has none)."""
    field = COMPONENTS if all(c in first.columns for c in COMPONENTS) else None
    return warp(first, second, dims, bsize, keys, COMPONENTS, field, affine, displacement=True)


def bspline_weights(u: np.ndarray) -> np.ndarray:
    """Cubic B-spline weights of control points j-1 .. j+2 at fraction u."""
    return np.stack([(1 - u) ** 3, 3 * u**3 - 6 * u**2 + 4, -3 * u**3 + 3 * u**2 + 3 * u + 1, u**3]) / 6.0


def bspline(controls: DataFrame, dims, spacing: int, keys=("ds",)) -> DataFrame:
    """Field of a cubic B-spline control grid as a block table (block = grid cell).

    `controls`: keys, cz, cy, cx, dz, dy, dx.  Each control point goes to the 64 cells
    it shapes; the voxels appear inside the cell's task.  Missing points count as 0.
    """
    df = controls.select(*keys, *[F.col(f"c{a}").alias(f"_c{i}") for i, a in enumerate("zyx")], *COMPONENTS)
    for i, b in enumerate(B.BLK):
        last = (int(dims[i]) - 1) // spacing
        lo = F.greatest(F.col(f"_c{i}") - 2, F.lit(0).cast("bigint"))
        hi = F.least(F.col(f"_c{i}") + 1, F.lit(last).cast("bigint"))
        df = df.where(lo <= hi).withColumn(b, F.explode(F.sequence(lo, hi)))
    at = [(F.col(f"_c{i}") - F.col(b) + 1) for i, b in enumerate(B.BLK)]
    entry = F.struct(((at[0] * 4 + at[1]) * 4 + at[2]).alias("at"), *COMPONENTS)
    cells = df.groupBy(*keys, *B.BLK).agg(F.collect_list(entry).alias("e"))
    base = B.block_skeleton(controls, dims, (spacing,) * 3, keys)
    cells = base.join(B.never_broadcast(cells), [*keys, *B.BLK], "left").select(
        *keys, *B.BLK, B._lit_array(dims).alias("dims"), B._lit_array((spacing,) * 3).alias("bsize"),
        F.col("e.at").alias("at"), *[F.col(f"e.{c}").alias(f"_{c}") for c in COMPONENTS],
    )
    keep = [*keys, *B.BLK, "dims", "bsize"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*keep).schema)

    def run(batches):
        for pdf in B.pieces(batches, B.block_bytes(3)):
            pdf = pdf.rename(columns={f"_{c}": f"c{c}" for c in COMPONENTS})
            made = {c: [] for c in COMPONENTS}
            for row in pdf.itertuples(index=False):
                wz, wy, wx = (bspline_weights(np.arange(n) / spacing) for n in B.core_shape(row))
                k = np.zeros((3, 64))
                if row.at is not None:
                    k[:, np.asarray(row.at, dtype=np.int64)] = [getattr(row, f"c{c}") for c in COMPONENTS]
                lines = np.matmul(wy.T, k.reshape(3, 4, 4, 4) @ wx)
                for c, v in zip(COMPONENTS, np.matmul(wz.T, lines.reshape(3, 4, -1))):
                    made[c].append(v.ravel())
            yield pdf[keep].assign(**made)

    return cells.mapInPandas(run, schema + "".join(f", {c} array<double>" for c in COMPONENTS))


def tent(n: int, first: int, block: int, size: int, overlap: int) -> np.ndarray:
    """Weight of block number `block` at coordinates first .. first + n - 1: 1 in its
    core, falling linearly to 0 across the overlap on either side."""
    x = np.arange(first, first + n)
    lo, hi = block * size - overlap, (block + 1) * size + overlap
    if overlap == 0:
        return ((x >= lo) & (x < hi)).astype(float)
    return np.clip(np.minimum((x - lo + 0.5), (hi - x - 0.5)) / (2.0 * overlap), 0.0, 1.0)


def blend(transforms: DataFrame, dims, bsize, overlap, keys=("ds",), affine="m") -> DataFrame:
    """One field from per-block affines: tent-weighted mean of the blocks that reach a voxel.

    `transforms`: keys, blk_z, blk_y, blk_x, m.  Only these small rows are shuffled, to
    the (at most 27) neighbouring blocks; overlap must not exceed half a block.
    """
    df = transforms.select(*keys, *[F.col(b).alias(f"_{b}") for b in B.BLK], F.col(affine).alias("m"))
    for b, d, s in zip(B.BLK, dims, bsize):
        last = (int(d) - 1) // int(s)
        lo = F.greatest(F.col(f"_{b}") - 1, F.lit(0).cast("bigint"))
        df = df.withColumn(b, F.explode(F.sequence(lo, F.least(F.col(f"_{b}") + 1, F.lit(last).cast("bigint")))))
    near = df.groupBy(*keys, *B.BLK).agg(
        F.collect_list(F.struct(F.array(*[F.col(f"_{b}") for b in B.BLK]).alias("b"), "m")).alias("e"))
    near = near.select(
        *keys, *B.BLK, B._lit_array(dims).alias("dims"), B._lit_array(bsize).alias("bsize"),
        F.flatten("e.b").alias("near"), F.flatten("e.m").alias("mats"),
    )
    keep = [*keys, *B.BLK, "dims", "bsize"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in near.select(*keep).schema)

    def run(batches):
        for pdf in B.pieces(batches, B.block_bytes(3)):
            made = {c: [] for c in COMPONENTS}
            for row in pdf.itertuples(index=False):
                org, core, x = B.core_origin(row), B.core_shape(row), block_positions(row)
                total, acc = 0.0, [0.0, 0.0, 0.0]
                for blk, m in zip(np.asarray(row.near).reshape(-1, 3), np.asarray(row.mats).reshape(-1, 3, 4)):
                    t = [tent(c, o, b, s, v) for c, o, b, s, v in zip(core, org, blk, bsize, overlap)]
                    w = t[0][:, None, None] * t[1][None, :, None] * t[2][None, None, :]
                    total = total + w
                    acc = [s + w * (m[i, 0] * x[0] + m[i, 1] * x[1] + m[i, 2] * x[2] + m[i, 3] - x[i]) for i, s in enumerate(acc)]
                for c, s in zip(COMPONENTS, acc):
                    made[c].append((s / total).ravel())
            yield pdf[keep].assign(**made)

    return near.mapInPandas(run, schema + "".join(f", {c} array<double>" for c in COMPONENTS))
