"""Spot detection and localisation; spots as points and as images."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.operators import blocks as B
from voxelloom.operators import filters as N
from voxelloom.session import cut


def sigma_range(blob_sizes, num_sigma_max: int | None = None) -> list[float]:
    """Scales for blob diameters smallest..largest, one a voxel of sigma; at most `num_sigma_max` where given."""
    lo, hi = [s / (2.0 * np.sqrt(3.0)) for s in blob_sizes]
    count = max(1, round(hi - lo) + 1)
    count = count if num_sigma_max is None else min(int(num_sigma_max), count)
    return [float(s) for s in np.linspace(lo, hi, count)]


def detect_log(blocks: DataFrame, sigmas, threshold: float, threshold_rel: float | None = None, keys=("ds",)) -> DataFrame:
    """Laplacian-of-gaussian blobs: keys, z, y, x, sigma, response, v.

    A blob is a strict maximum of the scale-normalised response over its neighbours in
    space and in scale.  Each block reports only voxels of its core, so tiles never
    report a spot twice.  `threshold_rel` is relative to the key's strongest response.
    """
    wide = max(N.radius(s) for s in sigmas)
    halo = [wide + 2] * 3

    def kernel(arrays, row):
        a = arrays[0]
        stack = []
        for s in sigmas:
            part = N.trim(a, [wide - N.radius(s)] * 3)
            r = s * s * N.laplace_array(N.smooth_array(part, [s] * 3))
            stack.append(np.where(N.inside(row, r.shape, [1, 1, 1]), r, -np.inf))
        found = {n: [] for n in ("z", "y", "x", "sigma", "response", "v")}
        org, raw = B.core_origin(row), N.trim(a, halo)
        for i, s in enumerate(sigmas):
            mid = N.trim(stack[i], (1, 1, 1))
            peak = N.strict_peaks(stack[i]) & (mid >= threshold)
            for j in (i - 1, i + 1):
                if 0 <= j < len(sigmas):
                    for _, view in N.neighbours(stack[j]):
                        peak &= mid > view
            pos = np.argwhere(peak)
            for k, n in enumerate("zyx"):
                found[n].append(pos[:, k] + org[k])
            found["sigma"].append(np.full(len(pos), s))
            found["response"].append(mid[peak])
            found["v"].append(raw[peak])
        return {n: np.concatenate(v) for n, v in found.items()}

    spots = B.map_block_rows(B.exchange(blocks, halo, ("v",), keys), kernel,
                             "z bigint, y bigint, x bigint, sigma double, response double, v double", halo, keys=keys)
    if threshold_rel is not None:
        spots = cut(spots)  # few rows; the detection must not run twice
        top = spots.groupBy(*keys).agg(F.max("response").alias("_top"))
        spots = spots.join(top, list(keys)).where(F.col("response") >= F.col("_top") * float(threshold_rel)).drop("_top")
    return spots


def detect_radial(blocks: DataFrame, threshold: float, dog=None, keys=("ds",)) -> DataFrame:
    """Sub-pixel spots by radial symmetry: keys, z, y, x (double), cz, cy, cx, v.

    Candidates are strict maxima of the image (or of its difference of gaussians for
    `dog=(small, large)`) of at least `threshold`.  The centre is the point closest to
    the gradient lines of the candidate's 27 voxels, from 3x3 normal equations.
    """
    wide = N.radius(dog[1]) if dog else 0
    halo = [wide + 2] * 3

    def kernel(arrays, row):
        a = arrays[0]
        img = N.trim(a, [wide] * 3)
        resp = img
        if dog:
            small = N.smooth_array(N.trim(a, [wide - N.radius(dog[0])] * 3), [dog[0]] * 3)
            resp = small - N.smooth_array(a, [dog[1]] * 3)
        resp = np.where(N.inside(row, resp.shape, [2, 2, 2]), resp, -np.inf)
        core = N.trim(resp, (2, 2, 2))
        pos = np.argwhere(N.strict_peaks(N.trim(resp, (1, 1, 1))) & (core >= threshold))
        grad = []
        for ax in range(3):
            lo, hi = [slice(1, -1)] * 3, [slice(1, -1)] * 3
            lo[ax], hi[ax] = slice(0, -2), slice(2, None)
            grad.append((img[tuple(hi)] - img[tuple(lo)]) / 2.0)
        real = N.inside(row, grad[0].shape, [1, 1, 1])
        n = len(pos)
        m, b = np.zeros((n, 3, 3)), np.zeros((n, 3))
        for dz in (-1, 0, 1):
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    at = tuple((pos + np.array([dz, dy, dx]) + 1).T)
                    g = np.stack([c[at] for c in grad], axis=1)
                    norm = (g * g).sum(axis=1)
                    use = (real[at] & (norm > 0)).astype(float)
                    w = np.eye(3)[None] - g[:, :, None] * g[:, None, :] / np.where(norm > 0, norm, 1.0)[:, None, None]
                    w = w * use[:, None, None]
                    m += w
                    b += w @ np.array([dz, dy, dx], dtype=float)
        ok = np.abs(np.linalg.det(m)) > 1e-9 if n else np.zeros(0, dtype=bool)
        shift = np.zeros((n, 3))
        if ok.any():
            shift[ok] = np.linalg.solve(m[ok], b[ok][:, :, None])[:, :, 0]
        org = np.array(B.core_origin(row))
        mid = pos + org
        out = {k: mid[:, i] + shift[:, i] for i, k in enumerate("zyx")}
        out.update({f"c{k}": mid[:, i] for i, k in enumerate("zyx")})
        out["v"] = N.trim(a, halo)[tuple(pos.T)]
        return out

    return B.map_block_rows(B.exchange(blocks, halo, ("v",), keys), kernel,
                            "z double, y double, x double, cz bigint, cy bigint, cx bigint, v double", halo, keys=keys)


def strongest(spots: DataFrame, n: int | None, keys=("ds",), value="v", slice_rows: int = 1 << 17) -> DataFrame:
    """The n strongest spots per key with their rank, ties by position; None keeps all of them, without a rank.

    First the best n of each salted slice of about `slice_rows` spots of the largest key, then the best n of those.
    """
    if n is None:
        return spots.withColumn("rank", F.lit(None).cast("int"))
    parts = max(1, -(-(spots.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) // max(slice_rows, 2 * int(n))))
    order = [F.desc(value), "z", "y", "x"]
    salt = F.pmod(F.xxhash64("z", "y", "x"), F.lit(parts))
    first = spots.withColumn("_s", salt).withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(*order)))
    best = first.where(F.col("_r") <= int(n)).drop("_s")
    final = best.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return final.where(F.col("_r") <= int(n)).withColumnRenamed("_r", "rank")


def enough(spots: DataFrame, minimum: int, keys=("ds",)) -> DataFrame:
    """Keys with at least `minimum` rows (guard before an alignment step)."""
    return spots.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= int(minimum))


def inside(points: DataFrame, mask: DataFrame, bsize, keys=("ds",)) -> DataFrame:
    """Points whose voxel lies in a mask (block table, column `m`): each looks into the block that holds it."""
    on = [*keys, *B.BLK]
    at = points.withColumns({b: F.floor(F.col(a) / int(n)).cast("bigint") for a, b, n in zip("zyx", B.BLK, bsize)})
    size = [F.least(F.lit(int(n)), F.col("dims")[i] - F.col(b) * int(n)) for i, (b, n) in enumerate(zip(B.BLK, bsize))]
    local = [F.floor(F.col(a)) - F.col(b) * int(n) for a, b, n in zip("zyx", B.BLK, bsize)]
    place = ((local[0] * size[1] + local[1]) * size[2] + local[2] + 1).cast("int")
    return at.join(mask.select(*on, "dims", "m"), on).where(F.element_at("m", place) != 0).select(*points.columns)


def spots_image(points: DataFrame, dims, bsize, scale=(1.0, 1.0, 1.0), ids=None, keys=("ds",)) -> DataFrame:
    """Spots per voxel of a reference grid, as a block table (0 where there are none)."""
    at = [F.floor(F.col(a) / float(s)).cast("bigint").alias(a) for a, s in zip("zyx", scale)]
    counts = points.groupBy(*keys, *at).agg(F.count("*").alias("v"))
    for a, d in zip("zyx", dims):
        counts = counts.where((F.col(a) >= 0) & (F.col(a) < int(d)))
    return B.pack(counts, dims, bsize, keys, ids=ids)
