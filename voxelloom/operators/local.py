"""Local registration: block-wise shifts, consensus and affines, blended into a displacement field; control points on top."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.functions import affine as A
from voxelloom.operators import blocks as B
from voxelloom.operators import fields as D
from voxelloom.operators import filters as N
from voxelloom.operators.warp import trilinear, warp
from voxelloom.session import cut


#: From so many shifts on, a block's scores are screened by Fourier transforms first.
SCREEN = 64


def _length(n: int) -> int:
    """The next number whose only factors are 2, 3 and 5."""
    while True:
        left = n
        for p in (2, 3, 5):
            while left % p == 0:
                left //= p
        if left == 1:
            return n
        n += 1


def _screen(f, m, real_f, real_m, reach, metric, fewest):
    """The shifts that can have the best score: sums of all shifts by Fourier transforms, with room for their rounding."""
    some = np.concatenate((f[real_f], m[real_m]))
    if not some.size:
        return []
    one = some.mean()
    a = np.where(real_f, f - (one if metric == "ssd" else f[real_f].mean() if real_f.any() else 0.0), 0.0)
    b = np.where(real_m, m - (one if metric == "ssd" else m[real_m].mean() if real_m.any() else 0.0), 0.0)
    size = [_length(n) for n in m.shape]
    wide = [np.fft.rfftn(x, size, (0, 1, 2)) for x in (real_m.astype(float), b, b * b)]
    valid = tuple(slice(0, 2 * r + 1) for r in reach)

    def sums(g, *others):
        own = np.conj(np.fft.rfftn(g, size, (0, 1, 2)))
        return [np.fft.irfftn(own * wide[i], size, (0, 1, 2))[valid] for i in others]

    n, sb, sbb = sums(real_f.astype(float), 0, 1, 2)
    sa, sab = sums(a, 0, 1)
    (saa,) = sums(a * a, 0)
    n = np.rint(n)
    use = n >= max(fewest, 1)
    n = np.maximum(n, 1)
    high_a, high_b = float((a * a).max()), float((b * b).max())
    if metric == "ssd":
        score, room, doubt = (saa - 2 * sab + sbb) / n, 1e-7 * (high_a + high_b), np.zeros(n.shape, dtype=bool)
    else:
        va, vb = saa / n - (sa / n) ** 2, sbb / n - (sb / n) ** 2
        doubt = (va <= 1e-7 * high_a) | (vb <= 1e-7 * high_b)  # flat or nearly so
        with np.errstate(divide="ignore", invalid="ignore"):
            score, room = -(sab / n - sa / n * sb / n) / np.sqrt(np.where(doubt, 1.0, va * vb)), 1e-5
    sure = score[use & ~doubt]
    best = sure.min() if sure.size else np.inf
    return np.argwhere(use & (doubt | (score <= best + room))).tolist()


def _scores(f, m, real_f, real_m, reach, metric, least=0.0):
    """Score (lower is better) and voxel count of the shifts of `m` against `f`, at least of those with the best score."""
    out = []
    fewest = least * int(real_f.sum())
    shape = [2 * r + 1 for r in reach]
    shifts = np.ndindex(*shape) if np.prod(shape) < SCREEN else _screen(f, m, real_f, real_m, reach, metric, fewest)
    for s in shifts:
        box = tuple(slice(o, o + n) for o, n in zip(s, f.shape))
        use = real_m[box] & real_f
        n = int(use.sum())
        if n < fewest:
            continue
        a, b = f[use], m[box][use]
        if metric == "ssd":
            score = float(((a - b) ** 2).sum()) / n if n else np.inf
        else:
            sa, sb = (a.std(), b.std()) if n else (0.0, 0.0)
            score = -float(((a - a.mean()) * (b - b.mean())).mean() / (sa * sb)) if sa > 0 and sb > 0 else np.inf
        shift = tuple(int(i) - r for i, r in zip(s, reach))
        out.append((score, sum(abs(v) for v in shift), shift, n))
    return out


def block_shifts(fix: DataFrame, mov: DataFrame, reach, overlap=(0, 0, 0), metric="ssd", mask: DataFrame | None = None,
                 keys=("ds",), least: float = 0.0) -> DataFrame:
    """Best integer shift of each block: keys, block id, dz, dy, dx, score, n.

    Voxel x of the fixed block is compared with x + shift of the moving volume; voxels
    beyond the border do not count, ties go to the smallest shift.  The blocks of both
    volumes meet by block id with just the halo that the search needs.  Blocks without
    a usable score (flat, or outside `mask`, column `m`) have no row.  A shift that leaves
    less than the share `least` of the block's voxels to compare does not count.
    """
    on = [*keys, *B.BLK]
    wide = [int(o) + int(r) for o, r in zip(overlap, reach)]
    f = fix if mask is None else fix.join(mask.select(*on, "m"), on)
    cols = ("v",) if mask is None else ("v", "m")
    fp = B.exchange(f, overlap, cols, keys)
    mp = B.exchange(mov, wide, ("v",), keys)
    both = fp.join(mp.select(*on, F.col("part_box").alias("box_w"), F.col("part_v").alias("part_w")), on)
    key_schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in both.select(*on).schema)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                a = B.assemble(row, "v", overlap)
                real_f = N.inside(row, a.shape, overlap)
                if mask is not None:
                    real_f = real_f & (B.assemble(row, "m", overlap) != 0)
                w = B.assemble(row._replace(part_box=row.box_w), "w", wide)
                found = _scores(a, w, real_f, N.inside(row, w.shape, wide), reach, metric, least)
                score, _, shift, n = min(found, default=(np.inf, 0, (0, 0, 0), 0))
                if np.isfinite(score):
                    out.append([*[getattr(row, c) for c in on], *shift, score, n])
            yield pd.DataFrame(out, columns=[*on, "dz", "dy", "dx", "score", "n"])

    return both.mapInPandas(run, f"{key_schema}, dz bigint, dy bigint, dx bigint, score double, n bigint")


def _normal_step(f, grads, w, count, inside, x):
    """(sum of squares, voxels, right-hand side, matrix) of one affine step with gain and offset of the moving values."""
    j = np.stack([*(g * xj for g in grads for xj in x), w, np.ones(w.size)])
    r, use = f - np.where(inside, w, 0.0), count * inside
    return float((count * r * r).sum()), float(count.sum()), (j * use) @ r, (j * use) @ j.T


def refine_block(f, m, real, low, dims, start, iterations: int, min_step: float, origin) -> tuple[np.ndarray, float, float]:
    """Affine of one block by damped Gauss-Newton: (3x4, first error, error).

    `f`: the fixed block, its first voxel at `origin`; `m`: the moving volume from `low` on; `real`: voxels that count.  A voxel
    that starts inside `m` and then leaves it counts as the block's mean, so losing overlap never looks like a better fit.
    """
    mean = f[real].mean() if real.any() else 0.0
    f, m = f - mean, m - mean
    grads = [np.gradient(f, axis=i).ravel() if f.shape[i] > 1 else np.zeros(f.size) for i in range(3)]
    at = [p.ravel() for p in np.meshgrid(*[np.arange(o, o + n, dtype=float) for o, n in zip(origin, f.shape)], indexing="ij")]
    mid = np.array([o + (n - 1) / 2.0 for o, n in zip(origin, f.shape)])
    x = [p - c for p, c in zip(at, mid)] + [np.ones(f.size)]
    scale = np.concatenate([np.maximum([(n - 1) / 2.0 for n in f.shape], 1.0), [1.0]])
    first = None

    def look(a):
        p = [a[i, 0] * at[0] + a[i, 1] * at[1] + a[i, 2] * at[2] + a[i, 3] for i in range(3)]
        within = np.ones(f.size, dtype=bool)
        for i in range(3):
            within &= (p[i] >= max(low[i], 0)) & (p[i] <= min(low[i] + m.shape[i], int(dims[i])) - 1)
        return within, trilinear(m, low, p)

    best, error, known, damping, tried = np.asarray(start, dtype=float), None, None, 1e-3, np.asarray(start, dtype=float)
    count = None
    for _ in range(iterations + 1):
        within, w = look(tried)
        if count is None:
            count = (real.ravel() & within).astype(float)
            if count.sum() < 64:  # fewer voxels do not hold 14 numbers
                return best, np.nan, np.nan
        square, n, right, h = _normal_step(f.ravel(), grads, w, count, within, x)
        fit = right[12:] @ np.linalg.lstsq(h[12:, 12:], right[12:], rcond=None)[0]
        now = max(square - fit, 0.0) / n
        if error is None or now < error:
            first = now if first is None else first
            best, error, known, damping = tried, now, (right, h), max(damping / 4, 1e-6)
        else:
            damping *= 8
        right, h = known
        d = np.linalg.solve(h + damping * np.diag(np.diag(h) + 1e-9 * np.trace(h) + 1e-12), right)[:12].reshape(3, 4)
        if (np.abs(d) * scale).sum(axis=1).max() < min_step or damping > 1e6:
            break
        inner = np.eye(4)
        inner[:3] += d
        inner[:3, 3] -= d[:, :3] @ mid
        tried = (np.vstack([best, [0, 0, 0, 1]]) @ inner)[:3]
    return best, first, error


def block_affines(fix: DataFrame, mov: DataFrame, start: DataFrame, reach, overlap=(0, 0, 0), iterations: int = 25, min_step: float = 1e-2,
                  smooth: float = 0.0, mask: DataFrame | None = None, keys=("ds",)) -> DataFrame:
    """Affine of each block refined by intensities: keys, block id, m, first_error, error.

    `start`: keys, block id, m; an affine takes fixed coordinates to those of `mov`, which lies on the same grid.  A block sees
    `overlap` voxels around it and, of the moving volume, `reach` more.  Blocks that are flat, outside `mask` (column `m`) or not
    improved have no row.
    """
    on = [*keys, *B.BLK]
    soft = N.radius(smooth)
    near, wide = [int(o) + soft for o in overlap], [int(o) + int(r) + soft for o, r in zip(overlap, reach)]
    f = fix if mask is None else fix.join(mask.select(*on, "m"), on)
    fp = B.exchange(f, near, ("v",) if mask is None else ("v", "m"), keys)
    mp = B.exchange(mov, wide, ("v",), keys)
    both = fp.join(mp.select(*on, F.col("part_box").alias("box_w"), F.col("part_v").alias("part_w")), on).join(start.select(*on, F.col("m").alias("start")), on)
    key_schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in both.select(*on).schema)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                a, w = B.assemble(row, "v", near), B.assemble(row._replace(part_box=row.box_w), "w", wide)
                if soft:
                    a, w = (N.smooth_array(v, [smooth] * 3) for v in (a, w))
                inner = [int(o) for o in overlap]
                real = N.inside(row, a.shape, inner)
                if mask is not None:
                    real = real & (N.trim(B.assemble(row, "m", near), [soft] * 3) != 0)
                org = B.core_origin(row)
                if real.any() and a[real].std() > 0:
                    low = [o - v + soft for o, v in zip(org, wide)]
                    m, first, error = refine_block(a, w, real, low, row.dims, np.asarray(row.start).reshape(3, 4), iterations, min_step, [o - v for o, v in zip(org, inner)])
                    if error < first:
                        out.append([*[getattr(row, c) for c in on], m.ravel(), first, error])
            yield pd.DataFrame(out, columns=[*on, "m", "first_error", "error"])

    return both.mapInPandas(run, f"{key_schema}, m array<double>, first_error double, error double")


def near_blocks(points: DataFrame, dims, bsize, reach) -> DataFrame:
    """Points with every block they lie in, or within `reach` voxels of: one row each."""
    out = points
    for a, b, d, n, r in zip("zyx", B.BLK, dims, bsize, reach):
        lo = F.greatest(F.ceil((F.col(a) - (int(r) + int(n) - 1)) / int(n)), F.lit(0).cast("bigint"))
        hi = F.least(F.floor((F.col(a) + int(r)) / int(n)), F.lit((int(d) - 1) // int(n)).cast("bigint"))
        out = out.withColumn(b, F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint"))))
    return out


def block_consensus(fix: DataFrame, mov: DataFrame, dims, bsize, reach, overlap, options: dict, keys=("ds",)) -> DataFrame:
    """Affine of each block by matched spots: keys, block id, m, inliers, total; blocks that miss a guard have no row.

    Spots of both volumes are found once; a block matches the fixed ones within its overlap with the moving ones within its
    overlap and reach.  `options`: those of the step `ransac`.
    """
    from voxelloom.operators import register as R
    from voxelloom.operators import spots as P

    on = [*keys, *B.BLK]
    sides = {}
    for name, blocks, far in (("fix", fix, overlap), ("mov", mov, [int(o) + int(r) for o, r in zip(overlap, reach)])):
        spots = cut(R.contexts(blocks, options["cc_radius"], options["threshold"], keys))
        spread = near_blocks(spots, dims, bsize, far)
        enough = P.enough(spread, options[f"{name}_spots_count_threshold"], on).select(*on)
        sides[name] = cut(spread.join(enough, on, "left_semi"))
    limit = R.distance_limit([int(b) + 2 * int(o) for b, o in zip(bsize, overlap)], options["max_spot_match_distance"], options["diagonal_constraint"])
    matches = cut(R.match(sides["fix"], sides["mov"], limit, options["match_threshold"], on))
    enough = P.enough(matches, options["point_matches_threshold"], on).select(*on)
    found = R.ransac(matches.join(enough, on, "left_semi"), options["align_threshold"], confidence=options["confidence"], least_share=options["least_share"], keys=on)
    return found.where(F.col("inliers") >= F.col("total") * options["least_share"])


#: Local steps in the order in which they may follow one another; `deform` works on the whole field.
STEPS = ("shift", "ransac", "affine", "deform")


def align(fix: DataFrame, mov: DataFrame, affine: DataFrame, dims, bsize, reach=None, overlap=None, mask: DataFrame | None = None,
          smooth: float = 0.0, inverse_iterations: int = 0, keys=("ds",), steps=("shift",), options: dict | None = None) -> dict[str, DataFrame]:
    """Block-wise alignment after a global affine: transforms, field, aligned volume.

    The moving volume is sampled through the affine.  `steps` are done in turn, each from what the one before it found:
    `shift` (best integer shift of a block), `ransac` (consensus affine of a block's matched spots), `affine` (a block's affine
    by intensities), then `deform` (control points of the whole field).  Blocks that fail a step keep what they have.  The
    blocks' transforms are blended (and optionally smoothed) to a field d on the fixed grid, so that aligned(x) = mov(A(x + d(x))).
    `options`: step -> its parameters.

    `reach` (largest shift) and `overlap` are voxels per axis, each half a block where not given.  A shift counts if
    it leaves an eighth of the block's voxels or more, as half a block in all three axes does.
    """
    options = options or {}
    if not set(steps) <= set(STEPS) or "deform" in list(steps)[:-1]:
        raise ValueError(f"steps must be of {STEPS}, deform the last one: {steps}")
    half = [int(n) // 2 for n in bsize]
    reach, overlap = half if reach is None else reach, half if overlap is None else overlap
    on = [*keys, *B.BLK]
    target = fix.select(*on, "dims", "bsize").join(affine.select(*keys, "m"), list(keys))
    transforms = fix.select(*on, A.identity().alias("m"), F.lit(False).alias("aligned"))
    moved = None
    for step in steps:
        if step == "deform":
            break
        moved = warp(target, mov, dims, bsize, keys) if moved is None else moved
        if len(steps) > 1:
            moved = cut(moved)
        if step == "shift":
            found = block_shifts(fix, moved, reach, overlap, "corr", mask, keys, 0.125)
            shift = A.translation(*[F.col(c).cast("double") for c in D.COMPONENTS])
            found = found.select(*on, shift.alias("new"))
        elif step == "ransac":
            found = block_consensus(fix, moved, dims, bsize, reach, overlap, options["ransac"], keys).select(*on, F.col("m").alias("new"))
        else:
            p = options.get("affine", {})
            found = block_affines(fix, moved, transforms, reach, overlap, p.get("iterations", 25), p.get("min_step", 1e-2), p.get("smooth", 0.0), mask, keys)
            found = found.select(*on, F.col("m").alias("new"))
        # one small row per block; each search runs once
        transforms = cut(transforms.join(found, on, "left").select(*on, F.coalesce("new", "m").alias("m"), (F.col("aligned") | F.col("new").isNotNull()).alias("aligned")))
    out = {"transforms": transforms}
    field = None
    if list(steps) != ["deform"]:
        field = D.blend(transforms, dims, bsize, overlap, keys)
        if smooth:
            field = N.smooth(field, [smooth] * 3, keys, D.COMPONENTS)
    if "deform" in steps:
        from voxelloom.operators import deform as Q

        p = {"spacing": 24, "factors": (1, 2), "smooth": (1.0, 0.25), **options.get("deform", {})}
        field = None if field is None else cut(field)
        out["controls"] = Q.fit(fix, mov, affine, dims, bsize, p["spacing"], p["factors"], p["smooth"], base=field, mask=mask, keys=keys,
                                **{k: v for k, v in p.items() if k not in ("spacing", "factors", "smooth")})
        field = Q.field(out["controls"], dims, bsize, p["spacing"] // p["factors"][-1], field, keys)
    out["field"] = field
    if inverse_iterations:
        out["inverse"] = D.invert(field, inverse_iterations, keys=keys)
    out["aligned"] = warp(field.join(affine.select(*keys, "m"), list(keys)), mov, dims, bsize, keys, field=D.COMPONENTS)
    return out
