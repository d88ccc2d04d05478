"""Neighbourhood filters: array kernels on blocks with halo, one shuffle each."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators import blocks as B


def gauss_weights(sigma: float) -> np.ndarray:
    """Normalised weights with radius ceil(3 sigma)."""
    if sigma <= 0:
        return np.ones(1)
    k = np.arange(-math.ceil(3 * sigma), math.ceil(3 * sigma) + 1)
    w = np.exp(-0.5 * (k / sigma) ** 2)
    return w / w.sum()


def radius(sigma: float) -> int:
    return math.ceil(3 * sigma) if sigma > 0 else 0


def smooth_array(a: np.ndarray, sigmas) -> np.ndarray:
    """Separable smoothing; each axis loses the radius of its kernel at both ends."""
    for ax, s in enumerate(sigmas):
        w = gauss_weights(s)
        n = a.shape[ax] - len(w) + 1
        a = sum(wk * np.take(a, range(k, k + n), axis=ax) for k, wk in enumerate(w))
    return a


def trim(a: np.ndarray, margin) -> np.ndarray:
    return a[tuple(slice(m, a.shape[i] - m) for i, m in enumerate(margin))]


def neighbours(a: np.ndarray):
    """The 27 shifted views of the inside of `a` (margin 1), centre included."""
    n = [s - 2 for s in a.shape]
    for dz in range(3):
        for dy in range(3):
            for dx in range(3):
                yield (dz, dy, dx), a[dz:dz + n[0], dy:dy + n[1], dx:dx + n[2]]


def strict_peaks(a: np.ndarray) -> np.ndarray:
    """True where the centre exceeds all 26 neighbours (margin 1 is lost)."""
    mid = trim(a, (1, 1, 1))
    peak = np.ones(mid.shape, dtype=bool)
    for at, view in neighbours(a):
        if at != (1, 1, 1):
            peak &= mid > view
    return peak


def inside(row, shape, margin) -> np.ndarray:
    """Which voxels of a block padded by `margin` lie in the volume."""
    axes = [
        (np.arange(n) + o - m >= 0) & (np.arange(n) + o - m < int(d))
        for n, o, m, d in zip(shape, B.core_origin(row), margin, row.dims)
    ]
    return axes[0][:, None, None] & axes[1][None, :, None] & axes[2][None, None, :]


def smooth(blocks: DataFrame, sigmas, keys=("ds",), cols=("v",)) -> DataFrame:
    """Gaussian smoothing of a volume, or of all components of a field."""
    halo = [radius(s) for s in sigmas]
    return B.map_blocks(
        B.exchange(blocks, halo, cols, keys), lambda arrays, row: [smooth_array(a, sigmas) for a in arrays],
        halo, cols, [(c, "double") for c in cols], keys,
    )


def dog(blocks: DataFrame, sigma_small: float, sigma_large: float, keys=("ds",)) -> DataFrame:
    """Difference of two gaussians from one halo exchange."""
    h, inner = radius(sigma_large), radius(sigma_large) - radius(sigma_small)

    def kernel(arrays, row):
        small = smooth_array(trim(arrays[0], [inner] * 3), [sigma_small] * 3)
        return [small - smooth_array(arrays[0], [sigma_large] * 3)]

    return B.map_blocks(B.exchange(blocks, [h] * 3, ("v",), keys), kernel, [h] * 3, keys=keys)


def laplace_array(a: np.ndarray) -> np.ndarray:
    """6 v - sum of the six face neighbours (margin 1 is lost)."""
    mid = trim(a, (1, 1, 1))
    out = 6 * mid
    for ax in range(3):
        for at in (0, 2):
            cut = [slice(1, -1)] * 3
            cut[ax] = slice(at, a.shape[ax] - 2 + at)
            out = out - a[tuple(cut)]
    return out


def laplace(blocks: DataFrame, keys=("ds",)) -> DataFrame:
    halo = (1, 1, 1)
    return B.map_blocks(B.exchange(blocks, halo, ("v",), keys), lambda arrays, row: [laplace_array(arrays[0])], halo, keys=keys)


def local_max(blocks: DataFrame, threshold: float | None = None, keys=("ds",)) -> DataFrame:
    """Voxels that strictly exceed their 26 neighbours: keys, z, y, x, v.

    A tie is no peak.  Beyond the border nothing competes, so the halo holds -inf.
    """

    def kernel(arrays, row):
        a = arrays[0]
        at = strict_peaks(a)
        if threshold is not None:
            at &= trim(a, (1, 1, 1)) >= threshold
        pos = np.argwhere(at)
        org = B.core_origin(row)
        z, y, x = [pos[:, i] + org[i] for i in range(3)]
        return {"z": z, "y": y, "x": x, "v": trim(a, (1, 1, 1))[at]}

    parts = B.exchange(blocks, (1, 1, 1), ("v",), keys)
    return B.map_block_rows(parts, kernel, "z bigint, y bigint, x bigint, v double", (1, 1, 1), keys=keys,
                            pad="constant", fill=-np.inf)


def morphology(blocks: DataFrame, steps, keys=("ds",), col="m") -> DataFrame:
    """3x3x3 minimum ('erode') and maximum ('dilate') steps in the given order.

    Opening is erode, dilate; closing dilate, erode.  One halo of len(steps) voxels
    serves all steps.  Outside the volume there are no voxels to compare with.
    """
    halo = [len(steps)] * 3

    def kernel(arrays, row):
        a = arrays[0].astype(float)
        real = inside(row, a.shape, halo)
        for step in steps:
            worst, best = (np.inf, np.minimum) if step == "erode" else (-np.inf, np.maximum)
            a = np.where(real, a, worst)
            a = best.reduce([v for _, v in neighbours(a)])
            real = trim(real, (1, 1, 1))
        return [a]

    return B.map_blocks(B.exchange(blocks, halo, (col,), keys), kernel, halo, (col,), [(col, "double")], keys)


def local_corr(fix: DataFrame, mov: DataFrame, r: int, keys=("ds",)) -> DataFrame:
    """Correlation in a (2r+1)^3 cube around every voxel, as a block table `r`.

    Voxels beyond the border do not count; flat neighbourhoods give NaN.
    """
    on = [*keys, *B.BLK]
    both = fix.withColumnRenamed("v", "a").join(mov.select(*on, F.col("v").alias("b")), on)
    halo = [r] * 3

    def box(a):
        for ax in range(3):
            n = a.shape[ax] - 2 * r
            a = sum(np.take(a, range(k, k + n), axis=ax) for k in range(2 * r + 1))
        return a

    def kernel(arrays, row):
        a, b = arrays
        one = (~np.isnan(a)).astype(float)
        a, b = np.nan_to_num(a), np.nan_to_num(b)
        n, sa, sb, saa, sbb, sab = [box(v) for v in (one, a, b, a * a, b * b, a * b)]
        va, vb = n * saa - sa * sa, n * sbb - sb * sb
        with np.errstate(invalid="ignore", divide="ignore"):
            return [np.where((va > 0) & (vb > 0), (n * sab - sa * sb) / (np.sqrt(va) * np.sqrt(vb)), np.nan)]

    parts = B.exchange(both, halo, ("a", "b"), keys)
    return B.map_blocks(parts, kernel, halo, ("a", "b"), [("r", "double")], keys, pad="constant", fill=np.nan)
