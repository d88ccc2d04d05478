"""Column expressions on affines: array<double> of 12, row-major 3x4, axes z, y, x."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]


def identity() -> Column:
    return F.array(*[F.lit(v) for v in IDENTITY])


def translation(z, y, x) -> Column:
    one, zero = F.lit(1.0), F.lit(0.0)
    return F.array(one, zero, zero, z, zero, one, zero, y, zero, zero, one, x)


def apply(m: Column, p) -> list[Column]:
    """Transformed z, y, x of the point columns `p`."""
    return [m[4 * i] * p[0] + m[4 * i + 1] * p[1] + m[4 * i + 2] * p[2] + m[4 * i + 3] for i in range(3)]


def compose(outer: Column, inner: Column) -> Column:
    """x -> outer(inner(x))."""
    out = []
    for i in range(3):
        for j in range(4):
            s = sum((outer[4 * i + k] * inner[4 * k + j] for k in range(1, 3)), outer[4 * i] * inner[j])
            out.append(s + outer[4 * i + 3] if j == 3 else s)
    return F.array(*out)


def physical(m: Column, fix_spacing, mov_spacing) -> Column:
    """The affine between voxels as one between physical positions of the two images."""
    return F.array(*[m[4 * i + j] * float(mov_spacing[i] if j == 3 else mov_spacing[i] / fix_spacing[j]) for i in range(3) for j in range(4)])


def voxels(m: Column, fix_spacing, mov_spacing) -> Column:
    """The affine between physical positions as one between voxels of images with these spacings."""
    return physical(m, [1.0 / s for s in fix_spacing], [1.0 / s for s in mov_spacing])


def shrunk(m: Column, factor) -> Column:
    """The affine between voxels as one between voxels of both volumes shrunk by `factor` (z, y, x).

    A coarse voxel lies in the middle of those that it stands for.
    """
    o = [(f - 1) / 2.0 for f in factor]
    rows = []
    for i in range(3):
        linear = [m[4 * i + j] * float(factor[j] / factor[i]) for j in range(3)]
        moved = sum((m[4 * i + j] * o[j] for j in range(1, 3)), m[4 * i] * o[0])
        rows += [*linear, (moved + m[4 * i + 3] - o[i]) / float(factor[i])]
    return F.array(*rows)


def grown(m: Column, factor) -> Column:
    """The inverse of `shrunk`: from voxels of the shrunk volumes to those of the whole ones."""
    o = [(f - 1) / 2.0 for f in factor]
    rows = []
    for i in range(3):
        linear = [m[4 * i + j] * float(factor[i] / factor[j]) for j in range(3)]
        moved = sum((linear[j] * o[j] for j in range(1, 3)), linear[0] * o[0])
        rows += [*linear, m[4 * i + 3] * float(factor[i]) + o[i] - moved]
    return F.array(*rows)


def invert(m: Column) -> Column:
    """Closed-form inverse; NULL when singular."""
    a = [[m[4 * i + j] for j in range(3)] for i in range(3)]
    cof = [[a[(j + 1) % 3][(i + 1) % 3] * a[(j + 2) % 3][(i + 2) % 3]
            - a[(j + 1) % 3][(i + 2) % 3] * a[(j + 2) % 3][(i + 1) % 3] for j in range(3)] for i in range(3)]
    det = a[0][0] * cof[0][0] + a[0][1] * cof[1][0] + a[0][2] * cof[2][0]
    inv = [[F.try_divide(cof[i][j], det) for j in range(3)] for i in range(3)]
    t = [m[3], m[7], m[11]]
    rows = [[*inv[i], -(inv[i][0] * t[0] + inv[i][1] * t[1] + inv[i][2] * t[2])] for i in range(3)]
    return F.when(det != 0, F.array(*[v for r in rows for v in r]))


def chain(affines: DataFrame, keys=("ds",)) -> DataFrame:
    """Ordered affine lists -> one matrix per key; the lowest `seq` acts first."""
    g = affines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "m"))).alias("l"))
    return g.select(*keys, F.aggregate("l", identity(), lambda acc, e: compose(e["m"], acc)).alias("m"))


def columns(m: Column, digits: int | None = 6) -> list[Column]:
    """The 12 entries as columns m00 .. m23."""
    vals = [m[i] if digits is None else F.round(m[i], digits) + F.lit(0.0) for i in range(12)]
    return [v.alias(f"m{i // 4}{i % 4}") for i, v in enumerate(vals)]
