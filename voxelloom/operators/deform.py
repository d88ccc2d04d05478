"""Free-form deformation: cubic B-spline control points fitted to two volumes.

The field on the fixed grid is u(x) = sum over control points of B(x) c; it is fitted so that mov(A(x + u(x))) looks like fix(x).
Each Gauss-Newton step warps the moving volume once and sums the normal equations of every grid cell in the cell's task: a cell
sees 64 control points with three components, and because the spline is a product over the axes its 192 x 192 matrix has 6000
different numbers.  The sparse system over all cells is solved by conjugate gradients.  For volumes of more than SMALL_CELLS cells
these are Spark rounds: matrices stay where they are (partitioned and sorted by cell once), a round moves 64 small rows a control
point and ends in one written table.  The equations of a smaller volume (50 MB at most) meet in one task.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.operators import blocks as B
from voxelloom.operators import fields as D
from voxelloom.operators import filters as N
from voxelloom.operators import register as R
from voxelloom.operators import stats as T
from voxelloom.operators.warp import block_positions, field_ends, warp
from voxelloom.session import cut, written

CONTROL = ("cz", "cy", "cx")
#: Cells of a volume whose equations one task solves.
SMALL_CELLS = 1024
#: Share of the compared voxels that must stay inside the moving volume.
LEAST_INSIDE = 0.75
#: Place of (a, b) among the ten products of two of four weights.
PAIR = np.zeros((4, 4), dtype=int)
for _k, (_a, _b) in enumerate(itertools.combinations_with_replacement(range(4), 2)):
    PAIR[_a, _b] = PAIR[_b, _a] = _k
FIRST, SECOND = (list(x) for x in zip(*itertools.combinations_with_replacement(range(4), 2)))
#: The six products of two of three components.
BOTH = list(itertools.combinations_with_replacement(range(3), 2))
#: Cells whose matrices a task writes out at a time: 19 MB.
WRITTEN_OUT = 64


def _full() -> np.ndarray:
    """Where each entry of a cell's 192 x 192 matrix is among its 6000 numbers."""
    numbers = np.arange(6000).reshape(6, 10, 10, 10)
    a, b, c = np.unravel_index(np.arange(64), (4, 4, 4))
    pairs = [PAIR[x[:, None], x[None]] for x in (a, b, c)]
    return np.block([[numbers[BOTH.index((min(i, j), max(i, j)))][tuple(pairs)] for j in range(3)] for i in range(3)])


FULL = _full()


def _bending() -> np.ndarray:
    """Differences between neighbours of a 4 x 4 x 4 lattice as a 64 x 64 matrix."""
    out = np.zeros((64, 64))
    at = np.arange(64).reshape(4, 4, 4)
    for ax in range(3):
        for p, q in zip(np.take(at, range(3), ax).ravel(), np.take(at, range(1, 4), ax).ravel()):
            out[p, p] += 1
            out[q, q] += 1
            out[p, q] -= 1
            out[q, p] -= 1
    return out


BENDING = _bending()


def lattice(ids: DataFrame, dims, spacing: int, keys=("ds",)) -> DataFrame:
    """All control points of a volume, at 0: keys, cz, cy, cx, dz, dy, dx."""
    out = ids.select(*keys).distinct()
    for c, d in zip(CONTROL, dims):
        out = out.withColumn(c, F.explode(F.sequence(F.lit(-1).cast("bigint"), F.lit((int(d) - 1) // spacing + 2).cast("bigint"))))
    return out.select(*keys, *CONTROL, *[F.lit(0.0).alias(c) for c in D.COMPONENTS])


def refine(controls: DataFrame, dims, spacing: int, keys=("ds",)) -> DataFrame:
    """The same field with control points at half of `spacing` (an even number of voxels)."""
    if spacing % 2:
        raise ValueError(f"a spacing of {spacing} cannot be halved")
    near = F.array(*[F.struct(F.lit(step).alias("step"), F.lit(w).alias("w")) for step, w in ((-2, 0.125), (-1, 0.5), (0, 0.75), (1, 0.5), (2, 0.125))])
    out, weight = controls, F.lit(1.0)
    for c, d in zip(CONTROL, dims):
        out = out.withColumn(f"_{c}", F.explode(near)).withColumn(c, F.col(c) * 2 + F.col(f"_{c}.step"))
        out = out.where((F.col(c) >= -1) & (F.col(c) <= (int(d) - 1) // (spacing // 2) + 2))
        weight = weight * F.col(f"_{c}.w")
    return out.groupBy(*keys, *CONTROL).agg(*[F.sum(F.col(c) * weight).alias(c) for c in D.COMPONENTS])


def _gather(controls: DataFrame, values: Sequence[str], dims, spacing: int, keys) -> DataFrame:
    """The control points of every cell: keys, block id, at (0 to 63), one array a value."""
    out = controls
    for b, c, d in zip(B.BLK, CONTROL, dims):
        lo, hi = F.greatest(F.col(c) - 2, F.lit(0).cast("bigint")), F.least(F.col(c) + 1, F.lit((int(d) - 1) // spacing).cast("bigint"))
        out = out.where(lo <= hi).withColumn(b, F.explode(F.sequence(lo, hi)))
    at = [F.col(c) - F.col(b) + 1 for b, c in zip(B.BLK, CONTROL)]
    entry = F.struct(((at[0] * 4 + at[1]) * 4 + at[2]).alias("at"), *values)
    out = out.groupBy(*keys, *B.BLK).agg(F.collect_list(entry).alias("e"))  # at most 64
    return out.select(*keys, *B.BLK, F.col("e.at").alias("at"), *[F.col(f"e.{v}").alias(v) for v in values])


def _placed(row, names: Sequence[str]) -> np.ndarray:
    """(3, 64) values of a cell's control points."""
    out = np.zeros((len(names), 64))
    at = np.asarray(row.at, dtype=np.int64)
    for i, n in enumerate(names):
        out[i, at] = getattr(row, n)
    return out


def _scatter(row, values: np.ndarray, keys) -> list[list]:
    """Rows (keys, control point, values) of a cell; `values` has one column a control point."""
    at = np.stack(np.unravel_index(np.arange(64), (4, 4, 4)), 1) + [int(getattr(row, b)) - 1 for b in B.BLK]
    return [[*[getattr(row, k) for k in keys], *c, *v] for c, v in zip(at.tolist(), values.T.tolist())]


def _contract(a: np.ndarray, weights) -> np.ndarray:
    """(k, z, y, x) with one matrix an axis, (p, z), (q, y) and (r, x): (k, p, q, r)."""
    wz, wy, wx = weights
    a = np.matmul(wy, a @ wx.T)
    return np.matmul(wz, a.reshape(*a.shape[:2], -1)).reshape(len(a), len(wz), len(wy), len(wx))


def normal_cell(v, w, use, grads, spacing: int) -> tuple[np.ndarray, np.ndarray]:
    """(192 right-hand sides, 6000 matrix entries) of a cell of residuals v - w with gradients (3, z, y, x)."""
    weights = [D.bspline_weights(np.arange(n) / spacing) for n in v.shape]
    pairs = [x[FIRST] * x[SECOND] for x in weights]
    right = _contract((v - w) * use * grads, weights)
    matrix = _contract(np.stack([grads[i] * grads[j] * use for i, j in BOTH]), pairs)
    return right.ravel(), matrix.ravel()


def product(matrix: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The cell's matrix times (3, 64) values."""
    return (matrix[FULL] @ p.ravel()).reshape(3, 64)


def products(matrices: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Matrices of cells that are written out, (n, 192, 192), times (n, 3, 64) values."""
    return np.matmul(matrices, p.reshape(len(p), 192, 1)).reshape(p.shape)


def diagonal(matrix: np.ndarray) -> np.ndarray:
    m, own = matrix.reshape(6, 10, 10, 10), np.diag(PAIR)
    return np.stack([m[BOTH.index((i, i))][np.ix_(own, own, own)].ravel() for i in range(3)])


def _schema(df: DataFrame, names) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*names).schema)


def _equations(cells, mov, controls, affine, base, dims, bsize, spacing, margin, keys) -> DataFrame:
    """Normal equations of every cell at `controls`: error, n, seen, trace, g, h.

    The error is that of the n voxels which start at least `margin` inside both volumes and still are inside; `seen` started so.
    """
    on = [*keys, *B.BLK]
    field = D.bspline(controls, dims, spacing, keys)
    if base is not None:
        add = base.select(*on, *[F.col(c).alias(f"_{c}") for c in D.COMPONENTS])
        field = field.join(B.never_broadcast(add), on).withColumns({c: F.zip_with(c, f"_{c}", lambda x, y: x + y) for c in D.COMPONENTS}).drop(*[f"_{c}" for c in D.COMPONENTS])
    ends = field_ends(D.COMPONENTS)
    target = cut(field.withColumns(ends).join(affine.select(*keys, "m"), list(keys)))
    moved = warp(target, mov, dims, bsize, keys, field=D.COMPONENTS, ends=list(ends)).select(*on, F.col("v").alias("w"))
    mask, start = "mask" in cells.columns, [f"_{c}" for c in D.COMPONENTS] if base is not None else []
    if start:
        cells = cells.join(B.never_broadcast(add), on)
    both = cells.join(B.never_broadcast(moved), on).join(B.never_broadcast(target.select(*on, "m", *D.COMPONENTS)), on)

    def run(batches):
        for pdf in batches:
            pdf, out = pdf.rename(columns={c: f"start{i}" for i, c in enumerate(start)}), []
            for row in pdf.itertuples(index=False):
                shape = B.core_shape(row)
                v, w, gz, gy, gx, *d = (np.asarray(getattr(row, c), dtype=float).reshape(shape) for c in ("v", "w", "gz", "gy", "gx", *D.COMPONENTS))
                count = np.asarray(row.mask, dtype=float).reshape(shape) if mask else np.ones(shape)
                own = block_positions(row)
                x = [p + q for p, q in zip(own, d)]
                first = [p + np.asarray(getattr(row, f"start{i}")).reshape(shape) for i, p in enumerate(own)] if start else own
                a, inside, seen = np.asarray(row.m, dtype=float).reshape(3, 4), np.ones(shape, dtype=bool), count
                for i, (n, edge) in enumerate(zip(dims, margin)):
                    p, q = (a[i, 0] * t[0] + a[i, 1] * t[1] + a[i, 2] * t[2] + a[i, 3] for t in (x, first))
                    inside &= (p >= 0) & (p <= n - 1)
                    for near in (q, own[i]):
                        seen = seen * ((near >= edge) & (near <= n - 1 - edge))
                g, h = normal_cell(v, w, count * inside, np.stack([gz, gy, gx]), spacing)
                out.append([*[getattr(row, k) for k in on], float((seen * inside * (v - w) ** 2).sum()), float((seen * inside).sum()), float(seen.sum()),
                            float(diagonal(h).sum()), g, h])
            yield pd.DataFrame(out, columns=[*on, "error", "n", "seen", "trace", "g", "h"])

    return both.mapInPandas(run, f"{_schema(cells, on)}, error double, n double, seen double, trace double, g array<double>, h array<double>")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _axpy(x: Column, scale: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda p, q: p + scale * q)


def _solve_small(rights: np.ndarray, matrices: list[np.ndarray], places: np.ndarray, controls: np.ndarray, stiff: float, rounds: int, tolerance: float,
                 damping: float) -> np.ndarray:
    """As `_solve`, for a dataset alone: steps (3, control points), from cells' (n, 3, 64) right-hand sides, n matrices and (n, 64)
    places among the control points."""
    runs = [slice(i, i + WRITTEN_OUT) for i in range(0, len(matrices), WRITTEN_OUT)]
    few = np.stack(matrices)[:, FULL] if len(runs) == 1 else None

    def total(parts):
        return np.stack([np.bincount(places.ravel(), parts[:, k].ravel(), controls.shape[1]) for k in range(3)])

    def at(values):
        return values[:, places].transpose(1, 0, 2)

    def times(p):
        return products(few, p) if few is not None else np.concatenate([products(np.stack(matrices[x])[:, FULL], p[x]) for x in runs])

    now = at(controls)
    r = total(rights - stiff * now @ BENDING)
    own = np.stack([diagonal(h) for h in matrices])
    d = total(own + stiff * np.diag(BENDING))
    m, more = d * (1 + damping) + 1e-9, d * damping + 1e-9
    x, p = np.zeros_like(r), r / m
    rz = start = float((r * p).sum())
    for _ in range(rounds):
        if rz <= start * tolerance ** 2:
            break
        here = at(p)
        q = total(times(here) + stiff * here @ BENDING) + more * p
        alpha = rz / float((p * q).sum())
        x, r = x + alpha * p, r - alpha * q
        before, rz = rz, float((r * r / m).sum())
        p = r / m + rz / before * p
    return x


def _judged_small(sums: DataFrame, tried: DataFrame, known: DataFrame | None, last: bool, dims, spacing: int, keys, stiffness: float, rounds: int,
                  tolerance: float, damping: float) -> DataFrame:
    """Each control point with `error` and `before` of its dataset, whether that is `better`, and if so and not `last` its new step.

    The equations of a dataset go to one task and are never written.
    """
    point = [*keys, *CONTROL]
    shape = [(int(d) - 1) // spacing + 4 for d in dims]
    offsets = np.ravel_multi_index(np.unravel_index(np.arange(64), (4, 4, 4)), shape)
    mine = tried.select(*point, *D.COMPONENTS)
    mine = mine.withColumn("before", F.lit(float("inf"))) if known is None else mine.join(known, list(keys))
    first = known is None

    def judge(cells: pd.DataFrame, controls: pd.DataFrame) -> pd.DataFrame:
        out = controls[point].assign(before=controls["before"])
        if not len(cells) or not len(controls):
            return out[:0].assign(error=0.0, better=False, new=None)
        before, n = float(controls["before"].iloc[0]), float(cells["n"].sum())
        error = float(cells["error"].sum()) / max(n, 1.0) if n >= LEAST_INSIDE * float(cells["seen"].sum()) else float("inf")
        better, new = first or error < before, [None] * len(out)
        if better and not last:
            here = np.ravel_multi_index([controls[c].to_numpy() + 1 for c in CONTROL], shape)
            values = np.zeros((3, int(np.prod(shape))))
            values[:, here] = controls[list(D.COMPONENTS)].to_numpy(dtype=float).T
            places = np.ravel_multi_index([cells[b].to_numpy() for b in B.BLK], shape)[:, None] + offsets
            stiff = float(cells["trace"].sum()) / (len(cells) * 192) * stiffness
            steps = _solve_small(np.stack(cells["g"]).reshape(-1, 3, 64), list(cells["h"]), places, values, stiff, rounds, tolerance, damping)
            new = list(steps[:, here].T)
        return out.assign(error=error, better=better, new=new)

    schema = f"{_schema(mine, point)}, before double, error double, better boolean, new array<double>"
    return sums.groupBy(*keys).cogroup(mine.groupBy(*keys)).applyInPandas(judge, schema)


def _solve(equations: DataFrame, controls: DataFrame, gauge: DataFrame, dims, spacing: int, keys, rounds: int, tolerance: float, damping: float) -> DataFrame:
    """Steps of all control points: keys, cz, cy, cx, x array of 3; conjugate gradients over the cells' equations.

    `gauge`: keys, stiff (weight of differences between neighbouring control points).
    """
    on, point = [*keys, *B.BLK], [*keys, *CONTROL]
    kind = f"{_schema(controls, point)}, "

    def begin(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                now = _placed(row, D.COMPONENTS)
                right = np.asarray(row.g).reshape(3, 64) - row.stiff * now @ BENDING
                out += _scatter(row, np.concatenate((right, diagonal(np.asarray(row.h)) + row.stiff * np.diag(BENDING))), keys)
            yield pd.DataFrame(out, columns=[*point, *[f"_{i}" for i in range(6)]])

    def multiply(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                p = _placed(row, ("p0", "p1", "p2"))
                out += _scatter(row, product(np.asarray(row.h), p) + row.stiff * p @ BENDING, keys)
            yield pd.DataFrame(out, columns=[*point, "q0", "q1", "q2"])

    def cells(rows: DataFrame, values) -> DataFrame:
        return equations.join(B.never_broadcast(_gather(rows, values, dims, spacing, keys)), on).join(gauge, list(keys))

    first = cells(controls, D.COMPONENTS).mapInPandas(begin, kind + ", ".join(f"_{i} double" for i in range(6)))
    first = first.groupBy(*point).agg(*[F.sum(f"_{i}").alias(f"_{i}") for i in range(6)])
    # a control point without any texture has nothing on its diagonal; the floor keeps it where its neighbours hold it
    first = first.select(*point, F.array(*[F.col(f"_{i}") for i in range(3)]).alias("r"), F.array(*[F.col(f"_{i + 3}") * (1 + damping) + 1e-9 for i in range(3)]).alias("m"),
                         F.array(*[F.col(f"_{i + 3}") * damping + 1e-9 for i in range(3)]).alias("more"))
    first = first.withColumn("p", F.zip_with("r", "m", lambda x, y: x / y)).withColumn("x", F.transform("r", lambda _: F.lit(0.0)))
    state = cut(first.withColumn("start", F.lit(None).cast("double")))
    for turn in range(rounds):
        rows = state.select(*point, *[F.col("p")[i].alias(f"p{i}") for i in range(3)])
        q = cells(rows, ("p0", "p1", "p2")).select(*on, "at", "p0", "p1", "p2", "h", "stiff").mapInPandas(multiply, kind + "q0 double, q1 double, q2 double")
        q = q.groupBy(*point).agg(*[F.sum(f"q{i}").alias(f"q{i}") for i in range(3)]).select(*point, F.array("q0", "q1", "q2").alias("q"))
        held = state.join(q, point).withColumn("q", F.zip_with("q", F.zip_with("more", "p", lambda x, y: x * y), lambda x, y: x + y))
        held = written(held, "rounds")
        z = [F.zip_with(c, "m", lambda x, y: x / y) for c in ("r", "q")]
        sums = held.groupBy(*keys).agg(F.sum(_dot(F.col("r"), z[0])).alias("rz"), F.sum(_dot(F.col("p"), F.col("q"))).alias("pq"),
                                       F.sum(_dot(F.col("r"), z[1])).alias("rq"), F.sum(_dot(F.col("q"), z[1])).alias("qq"))
        alpha = F.when(F.col("pq") > 0, F.col("rz") / F.col("pq")).otherwise(0.0)
        after = F.col("rz") - 2 * alpha * F.col("rq") + alpha * alpha * F.col("qq")  # r z of the next round
        sums = sums.select(*keys, "rz", alpha.alias("alpha"), F.when(F.col("rz") > 0, F.greatest(after, F.lit(0.0)) / F.col("rz")).otherwise(0.0).alias("beta"))
        state = held.join(sums, list(keys)).select(
            *point, "m", "more", F.coalesce("start", "rz").alias("start"), _axpy(F.col("x"), F.col("alpha"), F.col("p")).alias("x"),
            _axpy(F.col("r"), -F.col("alpha"), F.col("q")).alias("r"), "p", "beta", "rz")
        if turn + 1 == rounds or not state.where(F.col("rz") * F.col("beta") > F.col("start") * tolerance ** 2).head(1):
            break
        state = state.withColumn("p", _axpy(F.zip_with("r", "m", lambda x, y: x / y), F.col("beta"), F.col("p"))).drop("beta", "rz")
    return cut(state.select(*point, "x"))


def fit(fix: DataFrame, mov: DataFrame, affine: DataFrame, dims, bsize, spacing: int, factors: Sequence[int] = (1,), smooth: Sequence[float] = (1.0,),
        iterations: int = 10, min_step: float = 0.02, stiffness: float = 0.02, rounds: int = 12, tolerance: float = 0.1, damping: float = 0.02,
        margin=None, base: DataFrame | None = None, mask: DataFrame | None = None, keys=("ds",)) -> DataFrame:
    """Control points of the field u with mov(A(x + base(x) + u(x))) close to fix(x): keys, cz, cy, cx, dz, dy, dx.

    `spacing`: voxels between control points of the first level; a level with factor f has spacing / f (f a power of two, not
    falling), and smooths both volumes with its sigma of `smooth` (0: none).  Volumes are compared after a common standardisation
    of each; voxels outside `mask` (column `m`) do not count.  Displacements are in voxels.  `stiffness` weighs differences between
    neighbouring control points against the data (1: as much).  `margin`: voxels from either volume's border whose fit is not
    judged (by default one or two, more where an axis has 16 voxels).  A dataset whose error does not fall by a quarter of a step either, or whose largest
    step is under `min_step` voxels, is done with its level; a step that raises the error is never taken.  The result depends on the
    cells, not on the blocks of the volumes.
    """
    keys = list(keys)
    if len(smooth) != len(factors) or any(f & (f - 1) or f < 1 or spacing % f for f in factors) or list(factors) != sorted(factors):
        raise ValueError(f"one sigma a level and rising powers of two that divide {spacing}: {factors}, {smooth}")
    margin = [min(max(1, min(2, int(d) // 8)), (int(d) - 1) // 2) for d in dims] if margin is None else margin
    controls, now = None, spacing
    for factor, sigma in zip(factors, smooth):
        want = spacing // factor
        if controls is None:
            controls = lattice(fix, dims, want, keys)
        else:
            while now > want:
                controls, now = refine(controls, dims, now, keys), now // 2
        now, controls = want, cut(controls)
        sides = [T.standardize(cut(N.smooth(x, [sigma] * 3, keys) if sigma else x), keys) for x in (fix, mov)]
        cells = B.rechunk(sides[0], (want,) * 3, keys=keys)
        cells = R.gradients(cut(cells), keys)
        on = [*keys, *B.BLK]
        if mask is not None:
            inside = B.rechunk(mask, (want,) * 3, ("m",), keys)
            cells = cells.join(B.never_broadcast(inside.select(*on, F.col("m").alias("mask"))), on)
        own = None if base is None else cut(B.rechunk(base, (want,) * 3, D.COMPONENTS, keys).select(*on, *D.COMPONENTS))
        cells, moving = cut(cells), cut(sides[1])
        # a partition holds about 256 cells: 14 MB of matrices
        parts = max(1, -(-cells.count() // 256), min(int(fix.sparkSession.conf.get("spark.sql.shuffle.partitions")), cells.count()))
        controls = _level(cells, moving, controls, affine, own, dims, bsize, want, margin, keys, parts, iterations, min_step, stiffness, rounds, tolerance, damping)
    return controls


def _level(cells, moving, controls, affine, base, dims, bsize, spacing, margin, keys, parts, iterations, min_step, stiffness, rounds, tolerance, damping) -> DataFrame:
    """Gauss-Newton steps at one spacing.

    A step that does not lower a dataset's error is halved, twice at most; datasets leave the loop when they are done.
    """
    point, best, on = [*keys, *CONTROL], [f"b{c}" for c in D.COMPONENTS], [*keys, *B.BLK]
    small = int(np.prod([-(-int(d) // spacing) for d in dims])) <= SMALL_CELLS
    tried = controls.select(*point, *D.COMPONENTS, *[F.col(c).alias(b) for c, b in zip(D.COMPONENTS, best)],
                            F.array(*[F.lit(0.0)] * 3).alias("x"), F.lit(1.0).alias("gain"))
    tried, known, finished = written(tried, "controls"), None, None
    for turn in range(iterations + 1):
        equations = _equations(cells, moving, tried, affine, base, dims, bsize, spacing, margin, keys)
        if small:
            judged = written(_judged_small(equations, tried, known, turn == iterations, dims, spacing, keys, stiffness, rounds, tolerance, damping), "judged")
            errors = judged.select(*keys, "error", "before").distinct()
            took = tried.join(B.never_broadcast(judged.select(*point, "better", "new")), point)
        else:
            equations = cut(equations.repartition(parts, *on).sortWithinPartitions(*on))
            left = F.sum("n") >= LEAST_INSIDE * F.sum("seen")  # a fit that pushes more than that out of the volume is no fit
            errors = equations.groupBy(*keys).agg(F.when(left, F.sum("error") / F.greatest(F.sum("n"), F.lit(1.0))).otherwise(float("inf")).alias("error"),
                                                  (F.sum("trace") / (F.count("*") * 192) * stiffness).alias("stiff"))
            before = F.lit(float("inf")).alias("before")
            errors = errors.withColumn("before", before) if known is None else errors.join(known, keys)
            better = (F.col("error") < F.col("before")) if known is not None else F.lit(True)
            errors = written(errors.withColumn("better", better), "errors")
            took = tried.join(errors.select(*keys, "better"), keys)
        if turn == iterations:
            break
        if not small:
            step = _solve(equations, took.where("better").select(*point, *D.COMPONENTS), errors.where("better").select(*keys, "stiff"), dims, spacing, keys,
                          rounds, tolerance, damping).withColumnRenamed("x", "new")
            took = took.join(step, point, "left")
        held = took.select(
            *point, *[F.when(F.col("better"), F.col(c)).otherwise(F.col(b)).alias(b) for c, b in zip(D.COMPONENTS, best)],
            F.when(F.col("better"), F.col("new")).otherwise(F.col("x")).alias("x"), F.when(F.col("better"), 1.0).otherwise(F.col("gain") / 2).alias("gain"))
        held = held.select(*point, *[(F.col(b) + F.col("x")[i] * F.col("gain")).alias(c) for i, (c, b) in enumerate(zip(D.COMPONENTS, best))], *best, "x", "gain")
        tried = written(held, "controls")
        size = F.max(F.greatest(*[F.abs(F.col("x")[i]) for i in range(3)]) * F.col("gain"))
        done = tried.groupBy(*keys).agg(size.alias("size"), F.min("gain").alias("gain")).where((F.col("size") < float(min_step)) | (F.col("gain") < 0.2))
        known = errors.select(*keys, F.least("error", "before").alias("before"))
        if done.head(1):
            done = written(done.select(*keys), "done")
            over = tried.join(done, keys, "left_semi").select(*point, *[F.col(b).alias(c) for c, b in zip(D.COMPONENTS, best)])
            finished = over if finished is None else finished.unionByName(over)
            tried, known, cells, affine = (x.join(done, keys, "left_anti") for x in (tried, known, cells, affine))
            if not known.head(1):
                return cut(finished)
    last = took.select(*point, *[F.when(F.col("better"), F.col(c)).otherwise(F.col(b)).alias(c) for c, b in zip(D.COMPONENTS, best)])
    return cut(last if finished is None else finished.unionByName(last))


def field(controls: DataFrame, dims, bsize, spacing: int, base: DataFrame | None = None, keys=("ds",)) -> DataFrame:
    """The field of control points (plus `base`) as a block table with blocks of `bsize`."""
    keys, on = list(keys), [*keys, *B.BLK]
    out = B.rechunk(D.bspline(controls, dims, spacing, keys), bsize, D.COMPONENTS, keys)
    if base is None:
        return out
    add = base.select(*on, *[F.col(c).alias(f"_{c}") for c in D.COMPONENTS])
    return out.join(B.never_broadcast(add), on).withColumns({c: F.zip_with(c, f"_{c}", lambda x, y: x + y) for c in D.COMPONENTS}).drop(*[f"_{c}" for c in D.COMPONENTS])
