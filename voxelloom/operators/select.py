"""Selection, cropping, axis roles, spacing, masks and tiling of voxel views.

`None` always means "not given"; 0 is a valid time index or channel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def by_subpath(df: DataFrame, subpath: str | None) -> DataFrame:
    """Rows of one dataset of a container; a partition filter on stored tables."""
    return df if subpath is None else df.where(F.col("subpath") == subpath)


def by_time(df: DataFrame, index: int | None) -> DataFrame:
    return df if index is None else df.where(F.col("t") == int(index))


def by_channel(df: DataFrame, index: int | None) -> DataFrame:
    return df if index is None else df.where(F.col("c") == int(index))


def by_channels(df: DataFrame, channels) -> DataFrame:
    """Rows of the listed channels; an empty list keeps all of them."""
    return df.where(F.col("c").isin([int(c) for c in channels])) if channels else df


def crop(df: DataFrame, start, size, rebase: bool = True) -> DataFrame:
    """Box [start, start + size); coordinates restart at 0 unless `rebase` is off."""
    for a, s, n in zip(AXES, start, size):
        df = df.where((F.col(a) >= int(s)) & (F.col(a) < int(s) + int(n)))
    if rebase:
        df = df.withColumns({a: F.col(a) - int(s) for a, s in zip(AXES, start)})
    return df


def map_axes(df: DataFrame, index: str, z_axis: int, channel_axis: int | None, ndim: int) -> DataFrame:
    """Name the entries of an index array: z axis, optional channel axis, then y, x."""
    rest = [i for i in range(ndim) if i not in (z_axis, channel_axis)]
    roles = {"z": z_axis, "y": rest[-2], "x": rest[-1]}
    if channel_axis is not None:
        roles["c"] = channel_axis
    return df.withColumns({r: F.col(index)[i] for r, i in roles.items()}).drop(index)


def to_physical(df: DataFrame, spacing, offset=(0.0, 0.0, 0.0)) -> DataFrame:
    """Add pz, py, px = index * spacing + offset."""
    return df.withColumns(
        {f"p{a}": F.col(a) * F.lit(float(s)) + F.lit(float(o)) for a, s, o in zip(AXES, spacing, offset)}
    )


def to_index(df: DataFrame, spacing, offset=(0.0, 0.0, 0.0)) -> DataFrame:
    """Nearest voxel of physical pz, py, px in another grid (per-side spacing)."""
    return df.withColumns(
        {
            f"i{a}": F.floor((F.col(f"p{a}") - F.lit(float(o))) / F.lit(float(s)) + 0.5).cast("bigint")
            for a, s, o in zip(AXES, spacing, offset)
        }
    )


def scale_coords(df: DataFrame, resolution, downsampling=(1.0, 1.0, 1.0)) -> DataFrame:
    """Coordinates in pixels of a downsampled image -> physical units."""
    return df.withColumns(
        {a: F.col(a) * F.lit(float(r) * float(f)) for a, r, f in zip(AXES, resolution, downsampling)}
    )


def mask_values(mask: DataFrame, background=(0,)) -> DataFrame:
    """Mask voxels that count: all whose value is not listed as background."""
    return mask.where(~F.col("m").isin([int(v) for v in background]))


def apply_mask(vox: DataFrame, mask: DataFrame, keys=("ds",), scale=(1, 1, 1)) -> DataFrame:
    """Keep voxels inside the mask; `scale` = image voxels per mask voxel and axis."""
    if tuple(scale) == (1, 1, 1):
        return vox.join(mask.select(*keys, *AXES), [*keys, *AXES], "left_semi")
    small = mask.select(*keys, *[F.col(a).alias(f"_m{a}") for a in AXES])
    df = vox.withColumns({f"_m{a}": F.floor(F.col(a) / int(s)).cast("bigint") for a, s in zip(AXES, scale)})
    return df.join(small, [*keys, *[f"_m{a}" for a in AXES]], "left_semi").drop(*[f"_m{a}" for a in AXES])


def apply_mask_blocks(blocks: DataFrame, mask_blocks: DataFrame, keys=("ds",), col="v", mask_col="m") -> DataFrame:
    """Block form: voxels outside the mask become 0, blocks without a mask block wholly; joins block rows, not voxels."""
    on = [*keys, "blk_z", "blk_y", "blk_x"]
    df = blocks.join(mask_blocks.select(*on, mask_col), on, "left")
    zero = F.lit(0).cast(blocks.schema[col].dataType.elementType)
    zeroed = F.zip_with(col, mask_col, lambda v, m: F.when(m != 0, v).otherwise(zero))
    return df.withColumn(col, F.coalesce(zeroed, F.transform(col, lambda v: zero))).drop(mask_col)


def with_mask(blocks: DataFrame, mask_blocks: DataFrame, scale=(1, 1, 1), keys=("ds",), col="v", mask_col="m") -> DataFrame:
    """`blocks` with the mask's value at every voxel (array `mask_col`); joins block rows, not voxels.

    `scale`: image voxels per mask voxel and axis.  A mask of a lower resolution has blocks that are smaller by it, so a block
    meets the mask block of its own number.  Blocks without a mask block are left out.
    """
    on = [*keys, "blk_z", "blk_y", "blk_x"]
    own = mask_blocks.select(*on, mask_col, F.col("bsize").alias("_mb"))
    df = blocks.join(own, on)
    fits = F.lit(True)
    for i, s in enumerate(scale):
        fits = fits & (F.col("_mb")[i] * int(s) == F.col("bsize")[i])
    size = [F.least(F.col("bsize")[i], F.col("dims")[i] - F.col(b) * F.col("bsize")[i]) for i, b in enumerate(on[-3:])]
    if tuple(scale) != (1, 1, 1):
        low = [F.ceil(n / int(s)) for n, s in zip(size, scale)]
        df = df.withColumns({"_ny": size[1], "_nx": size[2], "_my": low[1], "_mx": low[2]})
        place = F.transform(F.sequence(F.lit(0).cast("bigint"), F.size(col).cast("bigint") - 1), lambda p: F.get(mask_col, (
            (F.floor(F.floor(p / (F.col("_ny") * F.col("_nx"))) / int(scale[0])) * F.col("_my")
             + F.floor(F.floor(p / F.col("_nx")) % F.col("_ny") / int(scale[1]))) * F.col("_mx") + F.floor(p % F.col("_nx") / int(scale[2]))).cast("int")))
        df = df.withColumn(mask_col, place).drop("_ny", "_nx", "_my", "_mx")
    checked = F.when(fits, F.col(mask_col)).otherwise(F.raise_error(F.lit("block sizes of image and mask do not fit the scale")))
    return df.withColumn(mask_col, checked).drop("_mb")


def skip_factors(spacing, working: float) -> list[int]:
    """Voxels to step per axis so that sampling comes near the working spacing."""
    return [max(1, int(working / s + 0.5)) for s in spacing]


def skip_sample(df: DataFrame, spacing, working: float) -> DataFrame:
    """Resample to a working spacing by striding; indices are renumbered."""
    k = skip_factors(spacing, working)
    for a, s in zip(AXES, k):
        df = df.where(F.col(a) % s == 0)
    return df.withColumns({a: F.expr(f"{a} div {s}") for a, s in zip(AXES, k)})


def overlap_voxels(bsize, overlap) -> list[int]:
    """Overlap in voxels from voxels (ints) or a fraction of the block (float)."""
    if isinstance(overlap, float):
        return [int(round(b * overlap / 2)) for b in bsize]
    return [int(o) for o in overlap]


def tile_overlap(vox: DataFrame, bsize, overlap, dims) -> DataFrame:
    """One row per voxel and block whose extended box covers it."""
    df = vox
    for a, b, o, d in zip(AXES, bsize, overlap_voxels(bsize, overlap), dims):
        last = (int(d) - 1) // int(b)
        lo = F.greatest(F.floor((F.col(a) - o) / int(b)).cast("bigint"), F.lit(0).cast("bigint"))
        hi = F.least(F.floor((F.col(a) + o) / int(b)).cast("bigint"), F.lit(last).cast("bigint"))
        df = df.withColumn(f"blk_{a}", F.explode(F.sequence(lo, hi)))
    return df
