"""Multiscale pyramids by block mean.

Border voxels of an odd axis average the voxels that exist.  Each level is the
mean of the level before it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators import blocks as B

AXES = ("z", "y", "x")


def level(vox: DataFrame, factor=(2, 2, 2), keys=("ds",), col="v") -> DataFrame:
    """One downsample level of a voxel view: one shuffle, combined map-side."""
    group = [F.expr(f"{a} div {int(f)}").alias(a) for a, f in zip(AXES, factor)]
    return vox.groupBy(*keys, *group).agg(F.avg(col).alias(col))


def level_dims(dims, factor=(2, 2, 2)):
    return [-(-int(d) // int(f)) for d, f in zip(dims, factor)]


def level_count(dims, stop: int) -> int:
    """Levels below full scale until every axis is at most `stop`."""
    n, dims = 0, list(dims)
    while max(dims) > stop:
        dims, n = level_dims(dims), n + 1
    return n


def halve(a: np.ndarray) -> np.ndarray:
    """Means of 2x2x2 voxels; at odd borders of those that exist."""
    total, count = a, np.ones_like(a)
    for ax in range(3):
        at = np.arange(0, total.shape[ax], 2)
        total = np.add.reduceat(total, at, axis=ax)
        count = np.add.reduceat(count, at, axis=ax)
    return total / count


def shrink(blocks: DataFrame, bsize, factor, keys=("ds",)) -> tuple[DataFrame, list[int]]:
    """(block table shrunk by `factor` per axis, its block size): means of the voxels that exist, made where the blocks lie.

    Blocks whose sides are no multiples of the factor are re-cut first (one shuffle); voxels never become rows.
    """
    factor = [int(f) for f in factor]
    whole = [-(-int(b) // f) * f for b, f in zip(bsize, factor)]
    if whole != [int(b) for b in bsize]:
        blocks = B.rechunk(blocks, whole, ("v",), keys)
    small = [w // f for w, f in zip(whole, factor)]
    keep = [*keys, *B.BLK, "dims", "bsize"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.select(*keep).schema)

    def run(batches):
        for pdf in batches:
            dims, values = [], []
            for row in pdf.itertuples(index=False):
                a = np.asarray(row.v, dtype=float).reshape(B.core_shape(row))
                count = np.ones_like(a)
                for ax, f in enumerate(factor):
                    at = np.arange(0, a.shape[ax], f)
                    a, count = (np.add.reduceat(x, at, axis=ax) for x in (a, count))
                dims.append(level_dims(row.dims, factor))
                values.append((a / count).ravel())
            yield pdf[[*keys, *B.BLK]].assign(dims=dims, bsize=[small] * len(dims), v=values)[[*keep, "v"]]

    return blocks.select(*keep, "v").mapInPandas(run, f"{fields}, v array<double>"), small


def full(blocks: DataFrame, levels: int, keys=("ds",), col="v") -> DataFrame:
    """All levels s0..sN of a block table without any shuffle.

    Blocks whose sides are multiples of 2**levels hold whole cells of every level,
    so each block makes its own part of the pyramid.  Output: block table with `scale`.
    """
    keep = [*keys, *B.BLK, "dims", "bsize"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.select(*keep).schema)

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                bsize = [int(s) for s in row.bsize]
                if any(s % 2**levels for s in bsize):
                    raise ValueError(f"block size {bsize} is no multiple of {2**levels}; rechunk first")
                org, core = B._core(row)
                a = np.asarray(getattr(row, col), dtype=float).reshape(core)
                dims = [int(d) for d in row.dims]
                for s in range(levels + 1):
                    if s:
                        a, dims, bsize = halve(a), level_dims(dims), [b // 2 for b in bsize]
                    rows.append({**{k: getattr(row, k) for k in (*keys, *B.BLK)}, "dims": dims,
                                 "bsize": bsize, "scale": s, col: a.ravel()})
            if rows:
                yield pd.DataFrame(rows)[[*keep, "scale", col]]

    return blocks.select(*keep, col).mapInPandas(run, f"{fields}, scale int, {col} array<double>")


def optional(blocks: DataFrame, generate: bool, levels: int, keys=("ds",), col="v") -> DataFrame:
    """The pyramid when asked for, else the input as its only scale."""
    if not generate:
        return blocks.withColumn("scale", F.lit(0))
    return full(blocks, levels, keys, col)
