"""Registration flow: global steps, local phase, further images; parameters per phase."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.functions import affine as A
from voxelloom.functions.params import deep_merge, phase_steps, step_params
from voxelloom.operators import fields as D
from voxelloom.operators import filters as N
from voxelloom.operators import local as LO
from voxelloom.operators import pyramid as Y
from voxelloom.operators import register as R
from voxelloom.operators import spots as P
from voxelloom.operators import stats as T
from voxelloom.operators import warp as W
from voxelloom.session import cut

#: Defaults; sections of a phase override the section of the same name.  None: all spots; shifts and overlap of half a block.  Local steps: `shift`, `ransac`, `affine`, `deform`.
DEFAULTS = {
    "ransac": {
        "threshold": 30.0, "nspots": None, "cc_radius": 20, "match_threshold": 0.6, "max_spot_match_distance": None,
        "point_matches_threshold": 50, "align_threshold": 2.0, "diagonal_constraint": 0.25,
        "fix_spots_count_threshold": 100, "mov_spots_count_threshold": 100, "confidence": 0.999, "least_share": 0.1,
        "safeguard_exceptions": True, "blob_sizes": None, "num_sigma_max": None, "threshold_rel": None, "winsorize_limits": None,
        "fix_spot_detection_kwargs": None, "mov_spot_detection_kwargs": None,
    },
    "affine": {"smooth": 1.0, "iterations": 100, "learning_rate": 1.0, "min_step": 1e-3, "initial_condition": None, "shrink_factors": None,
               "smooth_sigmas": None, "alignment_spacing": None},
    "global_align": {"steps": ["ransac"]},
    "deform": {"spacing": 24, "factors": [1, 2], "smooth": [1.0, 0.25], "iterations": 10, "min_step": 0.02},
    "local_align": {"steps": ["shift"], "reach": None, "overlap": None, "smooth": 0.0, "inverse_iterations": 0,
                    "affine": {"iterations": 25, "min_step": 1e-2, "smooth": 1.0},
                    "ransac": {"fix_spots_count_threshold": 20, "mov_spots_count_threshold": 20, "point_matches_threshold": 20}},
}


def find_spots(blocks: DataFrame, bsize, p: dict, side: str) -> DataFrame:
    """Spots of one side with their contexts: ds, z, y, x, v, patch.

    With `blob_sizes` (smallest and largest diameter) these are blobs of a Laplacian of Gaussian at scales between, of a response
    of `threshold` and of `threshold_rel` times the strongest one; their strength v is the response.  Without, they are strict
    maxima of `threshold` or more.  `winsorize_limits` (shares at both ends) clip the volume before.  The section
    `<side>_spot_detection_kwargs` overrides these options for a side.  Contexts are cut from the volume as it is.
    """
    o = {k: p[k] for k in ("threshold", "threshold_rel", "winsorize_limits")} | (p[f"{side}_spot_detection_kwargs"] or {})
    if o.get("blob_method", "log") != "log":
        raise ValueError(f"unknown blob method {o['blob_method']}")
    seen = blocks
    if o["winsorize_limits"] is not None:
        low, high = o["winsorize_limits"]
        seen = cut(T.winsorize_blocks(blocks, T.quantiles(W.B.unpack(blocks), [low, 1.0 - high])))
    if p["blob_sizes"] is None:
        if seen is blocks:
            return R.contexts(blocks, p["cc_radius"], o["threshold"])
        return R.contexts_at(blocks, R.contexts(seen, 1, o["threshold"]), p["cc_radius"], bsize)
    spots = P.detect_log(seen, P.sigma_range(p["blob_sizes"], p["num_sigma_max"]), o["threshold"], o["threshold_rel"])
    return R.contexts_at(blocks, spots.select("ds", "z", "y", "x", F.col("response").alias("v")), p["cc_radius"], bsize)


def ransac_step(fix, mov, current, dims, bsize, p, mask=None) -> DataFrame:
    """Spots, context matches, consensus affine on top of the current one; datasets that
    miss a guard, or whose best model agrees with less than `least_share` of the matches, keep what they have."""
    moved = through(fix, mov, current, dims, bsize)
    sides = {}
    for name, blocks in (("fix", fix), ("mov", moved)):
        spots = find_spots(blocks, bsize, p, name)
        if mask is not None and name == "fix":
            spots = P.inside(spots, mask, bsize)
        sides[name] = cut(P.strongest(spots, p["nspots"]).drop("rank"))
        ok = P.enough(sides[name], p[f"{name}_spots_count_threshold"])
        sides[name] = sides[name].join(ok.select("ds"), "ds", "left_semi")
    limit = R.distance_limit(dims, p["max_spot_match_distance"], p["diagonal_constraint"])
    matches = cut(R.match(sides["fix"], sides["mov"], limit, p["match_threshold"]))
    enough = P.enough(matches, p["point_matches_threshold"]).select("ds")
    found = R.ransac(matches.join(enough, "ds", "left_semi"), p["align_threshold"], confidence=p["confidence"], least_share=p["least_share"])
    found = cut(found.where(F.col("inliers") >= F.col("total") * p["least_share"]))  # a smaller consensus was not searched for: chance
    if not p["safeguard_exceptions"]:
        lost = current.join(found, "ds", "left_anti").count()
        if lost:
            raise ValueError(f"{lost} datasets have too few spots or matches, or no consensus")
    both = current.select("ds", F.col("m").alias("a")).join(found.select("ds", F.col("m").alias("b")), "ds", "left")
    return both.select("ds", A.compose(F.col("a"), F.coalesce("b", A.identity())).alias("m"))


def affine_step(fix, mov, current, dims, bsize, p, mask=None) -> DataFrame:
    """Intensity refinement of the current affine on smoothed, standardised volumes, from coarse to fine.

    A level shrinks both volumes by its factor of `shrink_factors` (axes that would keep fewer than eight voxels stay) and
    smooths them with its sigma of `smooth_sigmas`, in voxels of the level; so the iterations of a coarse level move a small
    volume.  With `alignment_spacing` (voxels) the volumes are first shrunk to about that.  `initial_condition` CENTER starts
    from the difference of the centres of mass.  `mask` (block table of the fixed volume, column `m`): only voxels inside count.
    """
    if p["initial_condition"] == "CENTER":
        current = cut(R.block_centres(fix, mov))
    elif p["initial_condition"] is not None:
        raise ValueError(f"unknown initial condition {p['initial_condition']}")
    factors, sigmas = p["shrink_factors"] or [1], p["smooth_sigmas"] or [p["smooth"]]
    if len(factors) != len(sigmas):
        raise ValueError(f"one sigma a level: {factors}, {sigmas}")
    base = max(1, int(p["alignment_spacing"] or 1))
    for shrink, sigma in zip(factors, sigmas):
        factor = [max(1, min(int(shrink) * base, d // 8)) for d in dims]
        sides, small, own = [fix, mov], [int(b) for b in bsize], list(dims)
        inside = mask if mask is None else mask.withColumnRenamed("m", "v")
        if max(factor) > 1:
            sides, own = [cut(Y.shrink(x, bsize, factor)[0]) for x in sides], Y.level_dims(dims, factor)
            inside = inside if inside is None else Y.shrink(inside, bsize, factor)[0]
            small = [-(-int(b) // f) for b, f in zip(bsize, factor)]
        if sigma:
            sides = [cut(N.smooth(x, [sigma] * 3)) for x in sides]
        sides = [T.standardize(x) for x in sides]
        if inside is not None:
            on = ["ds", *W.B.BLK]
            sides[0] = sides[0].join(inside.select(*on, F.transform("v", lambda v: F.when(v >= 0.5, 1.0).otherwise(0.0)).alias("mask")), on)
        margin = [max(1, min(N.radius(sigma), d // 8)) for d in own]  # smoothing repeats border voxels
        start = current.select("ds", A.shrunk(F.col("m"), factor).alias("m"))
        found = R.refine_affine(*sides, start, own, small, p["iterations"], p["learning_rate"], p["min_step"], margin=margin)
        current = cut(found.select("ds", A.grown(F.col("m"), factor).alias("m")))
    return current


STEPS: dict[str, Callable] = {"ransac": ransac_step, "affine": affine_step}


def through(fix, mov, affine, dims, bsize) -> DataFrame:
    """The moving volume sampled on the fixed grid through an affine."""
    target = fix.select("ds", *W.B.BLK, "dims", "bsize").join(affine.select("ds", "m"), "ds")
    return cut(W.warp(target, mov, dims, bsize))


def global_align(fix, mov, dims, bsize, steps: str | None = None, config: dict | None = None, init: DataFrame | None = None, mask: DataFrame | None = None):
    """Fold the steps; each starts from the affine its predecessor produced.  `mask`: block table of the fixed volume, column `m`."""
    cfg = deep_merge(DEFAULTS, config)
    current = init if init is not None else fix.select("ds").distinct().select("ds", A.identity().alias("m"))
    for step in phase_steps(cfg, "global_align", steps):
        current = cut(STEPS[step](fix, mov, current, dims, bsize, step_params(cfg, "global_align", step), mask))
    return current


@dataclass
class Pair:
    """Two block tables on grids of one shape, with the physical voxel sizes (z, y, x) of each."""

    fix: DataFrame
    mov: DataFrame
    dims: Sequence[int]
    bsize: Sequence[int]
    fix_spacing: Sequence[float] = (1.0, 1.0, 1.0)
    mov_spacing: Sequence[float] = (1.0, 1.0, 1.0)


def register(fix, mov, dims, bsize, global_steps=None, local_steps=None, config=None, mask=None, extra=None, init=None,
             spacing=(1.0, 1.0, 1.0), mov_spacing=None, local: Pair | None = None, global_mask=None) -> dict:
    """Both phases: affine, its inverse, field, aligned volumes; '' as steps skips a phase.

    The global phase runs on `fix` and `mov`, the local phase on `local` where given (another scale, say), else on the same
    pair.  Affines, `init` too, are in physical units: voxels times `spacing` (of the moving volume `mov_spacing`, if it
    differs).  The field is in voxels of the local pair, and `mask` and `extra` lie on its grid; `global_mask` lies on that of `fix`.  `extra`: further images (block
    table with `image` and `ds`) to warp with the result.
    """
    cfg = deep_merge(DEFAULTS, config)
    whole = Pair(cut(fix), cut(mov), dims, bsize, spacing, mov_spacing or spacing)
    start = init if init is not None else whole.fix.select("ds").distinct().select("ds", A.identity().alias("m"))
    affine = start
    if global_steps != "":
        start = start.select("ds", A.voxels(F.col("m"), whole.fix_spacing, whole.mov_spacing).alias("m"))
        found = global_align(whole.fix, whole.mov, dims, bsize, global_steps, config, start, global_mask)
        affine = cut(found.select("ds", A.physical(F.col("m"), whole.fix_spacing, whole.mov_spacing).alias("m")))
    out = {"affine": affine, "inverse_affine": affine.select("ds", A.invert(F.col("m")).alias("m"))}
    near = whole if local is None else replace(local, fix=cut(local.fix), mov=cut(local.mov))
    grid = affine.select("ds", A.voxels(F.col("m"), near.fix_spacing, near.mov_spacing).alias("m"))
    target = near.fix.select("ds", *W.B.BLK, "dims", "bsize").join(grid, "ds")
    if local_steps == "":
        out["aligned"] = W.warp(target, near.mov, near.dims, near.bsize)
    else:
        p, steps = cfg["local_align"], phase_steps(cfg, "local_align", local_steps)
        options = {step: step_params(cfg, "local_align", step) for step in ("ransac", "affine", "deform")}
        out.update(LO.align(near.fix, near.mov, grid, near.dims, near.bsize, p["reach"], p["overlap"], mask, p["smooth"], p["inverse_iterations"],
                            steps=steps, options=options))
        target = cut(out["field"]).join(grid, "ds")
        out["field"] = target.drop("m")
    if extra is not None:
        copies = target.join(extra.select("ds", "image").distinct(), "ds")
        field = None if local_steps == "" else D.COMPONENTS
        out["extra"] = W.warp(copies, extra, near.dims, near.bsize, ("ds", "image"), field=field)
    return out
