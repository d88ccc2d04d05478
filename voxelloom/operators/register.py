"""Global registration: spot contexts, matching, consensus affines, intensity refinement."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.functions import affine as A
from voxelloom.operators import blocks as B
from voxelloom.operators import filters as N
from voxelloom.operators.warp import block_positions, warp
from voxelloom.session import cut

FIX, MOV = ("fz", "fy", "fx"), ("mz", "my", "mx")


def unit(a: np.ndarray) -> np.ndarray:
    a = a - a.mean()
    length = np.sqrt((a * a).sum())
    return a / length if length > 0 else np.zeros_like(a)


def contexts(blocks: DataFrame, r: int, threshold: float, keys=("ds",)) -> DataFrame:
    """Strict maxima of at least `threshold` with the (2r+1)^3 cube around each.

    Cubes (`patch`) are shifted and scaled to mean 0 and length 1; flat ones are all 0.
    """
    halo = [max(r, 1)] * 3

    def kernel(arrays, row):
        a = arrays[0]
        seen = np.where(N.inside(row, a.shape, halo), a, -np.inf)
        core = N.trim(a, halo)
        pos = np.argwhere(N.strict_peaks(N.trim(seen, [h - 1 for h in halo])) & (core >= threshold))
        org = B.core_origin(row)
        start = halo[0] - r
        cubes = [unit(a[tuple(slice(p + start, p + start + 2 * r + 1) for p in at)].ravel()) for at in pos]
        return {**{n: pos[:, i] + org[i] for i, n in enumerate("zyx")}, "v": core[tuple(pos.T)], "patch": cubes}

    return B.map_block_rows(B.exchange(blocks, halo, ("v",), keys), kernel,
                            "z bigint, y bigint, x bigint, v double, patch array<double>", halo, keys=keys)


def contexts_at(blocks: DataFrame, spots: DataFrame, r: int, bsize, keys=("ds",)) -> DataFrame:
    """Spots (keys, z, y, x, v at voxel positions) with the cube around each, as `contexts` makes it; one row a position."""
    on, halo = [*keys, *B.BLK], [max(r, 1)] * 3
    at = spots.groupBy(*keys, "z", "y", "x").agg(F.max("v").alias("v"))
    at = at.withColumns({b: F.floor(F.col(a) / int(n)).cast("bigint") for a, b, n in zip("zyx", B.BLK, bsize)})
    at = at.groupBy(*on).agg(F.collect_list(F.struct("z", "y", "x", "v")).alias("s"))  # voxels of one block at most
    near = B.exchange(blocks, halo, ("v",), keys).join(at.select(*on, *[F.col(f"s.{c}").alias(f"s{c}") for c in "zyxv"]), on)
    start = halo[0] - r

    def kernel(arrays, row):
        org = B.core_origin(row)
        pos = [np.asarray(getattr(row, f"s{c}"), dtype=np.int64) for c in "zyx"]
        first = np.stack([p - o + start for p, o in zip(pos, org)], 1)
        cubes = [unit(arrays[0][tuple(slice(i, i + 2 * r + 1) for i in f)].ravel()) for f in first]
        return {**dict(zip("zyx", pos)), "v": np.asarray(row.sv, dtype=float), "patch": cubes}

    return B.map_block_rows(near, kernel, "z bigint, y bigint, x bigint, v double, patch array<double>", halo, keys=keys)


def near_pairs(fix: DataFrame, mov: DataFrame, max_distance: float, keys=("ds",)) -> DataFrame:
    """Fixed and moving spots within a distance: fz .. mx, dist2.

    Grid cells as wide as the distance make it an equi-join.  Spots are strict maxima
    on a lattice, so a cell holds a bounded number of them.
    """
    cell = float(max_distance)
    f = fix.select(*keys, *[F.col(a).alias(n) for a, n in zip("zyx", FIX)])
    m = mov.select(*keys, *[F.col(a).alias(n) for a, n in zip("zyx", MOV)])
    for i in range(3):
        c = F.floor(F.col(FIX[i]) / cell)
        f = f.withColumn(f"_c{i}", F.explode(F.sequence(c - 1, c + 1)))
        m = m.withColumn(f"_c{i}", F.floor(F.col(MOV[i]) / cell))
    d = [F.col(a) - F.col(b) for a, b in zip(FIX, MOV)]
    df = f.join(m, [*keys, "_c0", "_c1", "_c2"]).withColumn("dist2", (d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).cast("double"))
    return df.where(F.col("dist2") <= cell * cell).drop("_c0", "_c1", "_c2")


def distance_limit(dims, max_distance: float | None, diagonal: float | None) -> float:
    """The tighter of a distance and a fraction of the volume's diagonal."""
    limits = [] if max_distance is None else [float(max_distance)]
    if diagonal is not None:
        limits.append(diagonal * math.sqrt(sum(float(d) ** 2 for d in dims)))
    if not limits:
        raise ValueError("matching needs a distance or a diagonal limit")
    return min(limits)


def match(fix: DataFrame, mov: DataFrame, limit: float, min_r: float, keys=("ds",)) -> DataFrame:
    """Best moving spot for each fixed spot by correlation of their contexts.

    Pairs are found on positions alone; contexts (`patch`, mean 0 and length 1, so that
    their product is the correlation) join the pairs afterwards.  Both inputs are read
    twice: pass stored ones.
    """
    fp = fix.select(*keys, *[F.col(a).alias(n) for a, n in zip("zyx", FIX)], F.col("patch").alias("fp"))
    mp = mov.select(*keys, *[F.col(a).alias(n) for a, n in zip("zyx", MOV)], F.col("patch").alias("mp"))
    pairs = near_pairs(fix, mov, limit, keys).join(fp, [*keys, *FIX]).join(mp, [*keys, *MOV])
    keep = [*keys, *FIX, *MOV, "dist2"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*keep).schema) + ", r double"

    def correlate(batches):
        for pdf in batches:
            r = [float(np.dot(a, b)) if len(a) else np.nan for a, b in zip(pdf["fp"], pdf["mp"])]
            yield pdf[keep].assign(r=np.array(r, dtype=float))

    scored = pairs.select(*keep, "fp", "mp").mapInPandas(correlate, schema)
    scored = scored.withColumn("r", F.round("r", 6)).where(F.col("r") >= float(min_r))
    rank = F.struct("r", *[(-F.col(c)).alias(f"_{c}") for c in MOV])
    best = F.max_by(F.struct(*MOV, "r", "dist2"), rank)
    return scored.groupBy(*keys, *FIX).agg(best.alias("b")).select(*keys, *FIX, "b.*")


def consensus_shift(matches: DataFrame, tolerance: float, keys=("ds",)) -> DataFrame:
    """The observed integer shift with the most matches within `tolerance` of it.

    Equal shifts are counted first; each count then votes for the lattice shifts inside
    the tolerance ball, so nothing is compared pair by pair.
    """
    t = int(math.floor(tolerance))
    ball = [(z, y, x) for z in range(-t, t + 1) for y in range(-t, t + 1) for x in range(-t, t + 1)
            if z * z + y * y + x * x <= tolerance * tolerance]
    shift = [(F.col(m) - F.col(f)).cast("bigint").alias(n) for f, m, n in zip(FIX, MOV, ("sz", "sy", "sx"))]
    seen = cut(matches.groupBy(*keys, *shift).agg(F.count("*").alias("n")))
    offs = F.explode(F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip(("z", "y", "x"), b)]) for b in ball]))
    votes = seen.withColumn("o", offs).groupBy(
        *keys, *[(F.col(f"s{a}") + F.col(f"o.{a}")).alias(f"s{a}") for a in "zyx"]).agg(F.sum("n").alias("inliers"))
    votes = votes.join(seen.drop("n"), [*keys, "sz", "sy", "sx"], "left_semi")
    size = -(F.col("sz") * F.col("sz") + F.col("sy") * F.col("sy") + F.col("sx") * F.col("sx"))
    rank = F.struct("inliers", size.alias("d"), *[(-F.col(f"s{a}")).alias(f"n{a}") for a in "zyx"])
    return votes.groupBy(*keys).agg(F.max_by(F.struct("sz", "sy", "sx", "inliers"), rank).alias("b")).select(*keys, "b.*")


NORMAL = ["n"] + [f"s_{a}" for a in "zyx"] + [f"s_{a}{b}" for i, a in enumerate("zyx") for b in "zyx"[i:]] + \
    [f"t{t}_{a}" for t in "zyx" for a in "zyx1"]


def normal_sums(matches: DataFrame, keys=("ds",)) -> DataFrame:
    """Sums of the normal equations of m = A f: one aggregate, one row per key."""
    p = dict(zip("zyx", [F.col(c).cast("double") for c in FIX]))
    q = dict(zip("zyx", [F.col(c).cast("double") for c in MOV]))
    sums = {"n": F.count("*").cast("double")}
    for i, a in enumerate("zyx"):
        sums[f"s_{a}"] = F.sum(p[a])
        for b in "zyx"[i:]:
            sums[f"s_{a}{b}"] = F.sum(p[a] * p[b])
        for t in "zyx":
            sums[f"t{t}_{a}"] = F.sum(q[t] * p[a])
    for t in "zyx":
        sums[f"t{t}_1"] = F.sum(q[t])
    return matches.groupBy(*keys).agg(*[sums[n].alias(n) for n in NORMAL])


def solve_normal(sums: DataFrame, keys=("ds",)) -> DataFrame:
    """Least-squares affine of each key; keys whose points do not span space drop out."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.select(*keys).schema) + ", m array<double>"

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                get = lambda a, b: row.get(f"s_{a}{b}", row.get(f"s_{b}{a}"))
                left = np.array([[get(a, b) for b in "zyx"] + [row[f"s_{a}"]] for a in "zyx"] + [[row[f"s_{b}"] for b in "zyx"] + [row["n"]]])
                if np.linalg.matrix_rank(left) == 4:
                    right = np.array([[row[f"t{t}_{a}"] for t in "zyx"] for a in "zyx1"])
                    out.append({**{k: row[k] for k in keys}, "m": np.linalg.solve(left, right).T.ravel()})
            yield pd.DataFrame(out, columns=[*keys, "m"])

    return sums.mapInPandas(run, schema)


def fit_affine(matches: DataFrame, keys=("ds",)) -> DataFrame:
    return solve_normal(normal_sums(matches, keys), keys)


def residual2(m, f=FIX, t=MOV):
    """Squared distance between the transformed fixed point and its partner."""
    d = [a - F.col(b) for a, b in zip(A.apply(m, [F.col(c) for c in f]), t)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def trials_needed(share: float, confidence: float, size: int = 4) -> float:
    """Samples of `size` matches until one is free of outliers with the given confidence."""
    return 1.0 if share >= 1 else math.log(1 - confidence) / math.log1p(-share**size)


def ransac(matches: DataFrame, threshold: float, *, confidence: float = 0.999, least_share: float = 0.1, batch: int = 64, keys=("ds",)) -> DataFrame:
    """Consensus affine per key: keys, m, inliers, total, hypothesis.

    A hypothesis splits the matches of a key into four by hash and takes the one with the smallest hash of each part, an
    aggregate that combines map-side.  Its cost is the sum of squared distances, each at most threshold squared, so of
    models with equal inliers the closer one wins.  Trials double until every key has enough for its best inlier share (and
    `confidence`); a consensus of less than `least_share` of the matches is not searched for.  The winner is refitted to
    the matches that agree with it as closely as the median one does.
    """
    if not 0 < confidence < 1 or not 0 < least_share <= 1:
        raise ValueError(f"confidence must lie between 0 and 1 and least_share be over 0, 1 at most: {confidence}, {least_share}")
    keys = list(keys)
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in matches.select(*keys).schema)
    totals = matches.groupBy(*keys).agg(F.count("*").alias("total"))
    best, done = None, 0
    while True:
        size = batch if not done else done
        found = cut(_trials(matches, threshold, done, done + size, keys, key_schema))
        best = found if best is None else best.unionByName(found)
        rank = F.struct("cost", "hyp")
        best = cut(best.groupBy(*keys).agg(F.min_by(F.struct("m", "n", "cost", "hyp"), rank).alias("b")).select(*keys, "b.*"))
        done += size
        share = best.join(totals, keys).agg(F.min(F.greatest(F.col("n") / F.col("total"), F.lit(float(least_share))))).first()[0]
        if share is None or done >= trials_needed(share, confidence):
            break
    best = best.select(*keys, F.col("m").alias("_m"), F.col("n").alias("inliers"), F.col("hyp").alias("hypothesis"))
    close = matches.join(best, keys).withColumn("_d", F.sqrt(residual2(F.col("_m")))).where(F.col("_d") <= float(threshold))
    spread = close.groupBy(*keys).agg(F.percentile_approx("_d", 0.5).alias("_mid"))
    near = close.join(spread, keys).where(F.col("_d") <= F.greatest(F.col("_mid") * 3 * 1.4826, F.lit(0.1 * threshold)))
    refit = fit_affine(near, keys)
    return best.join(refit, keys, "left").join(totals, keys).select(*keys, F.coalesce("m", "_m").alias("m"), "inliers", "total", "hypothesis")


def _trials(matches, threshold: float, start: int, stop: int, keys, key_schema: str) -> DataFrame:
    """(keys, hyp, m, n, cost) of hypotheses start..stop - 1."""
    point = [*FIX, *MOV]
    trial = matches.select(*keys, *point).withColumn("hyp", F.explode(F.sequence(F.lit(start), F.lit(stop - 1))))
    trial = trial.withColumn("slot", F.pmod(F.xxhash64(*point, "hyp"), F.lit(4)))
    pick = F.min_by(F.array(*[F.col(c).cast("double") for c in point]), F.xxhash64(*point, "hyp", F.lit(17)))
    quads = trial.groupBy(*keys, "hyp", "slot").agg(pick.alias("p"))
    quads = quads.groupBy(*keys, "hyp").agg(F.flatten(F.collect_list("p")).alias("p")).where(F.size("p") == 24)

    def solve(batches):
        for pdf in batches:
            p = np.array(pdf["p"].to_list(), dtype=float).reshape(-1, 4, 6)
            left = np.concatenate([p[:, :, :3], np.ones((len(p), 4, 1))], axis=2)
            ok = np.abs(np.linalg.det(left)) > 1e-6 if len(p) else np.zeros(0, dtype=bool)
            m = np.linalg.solve(left[ok], p[ok][:, :, 3:]).transpose(0, 2, 1).reshape(-1, 12)
            yield pdf.loc[ok, [*keys, "hyp"]].assign(m=list(m))

    hyps = cut(quads.mapInPandas(solve, f"{key_schema}, hyp int, m array<double>"))
    part = (F.col("hyp") - start) % max(1, (stop - start) // 256)  # a row holds 256 models at most
    packed = hyps.groupBy(*keys, part.alias("_part")).agg(F.collect_list("hyp").alias("hyps"), F.flatten(F.collect_list("m")).alias("ms"))

    def count(batches):
        for pdf in batches:
            for _, rows in pdf.groupby([*keys, "_part"], sort=False):
                hyp = np.asarray(rows["hyps"].iloc[0])
                m = np.asarray(rows["ms"].iloc[0]).reshape(-1, 3, 4)
                n, cost = np.zeros(len(m), np.int64), np.zeros(len(m))
                for at in range(0, len(rows), 2048):
                    f, t = (rows[list(c)].to_numpy(float)[at:at + 2048] for c in (FIX, MOV))
                    d2 = ((np.einsum("hij,nj->hni", m[:, :, :3], f) + m[:, None, :, 3] - t[None]) ** 2).sum(axis=2)
                    n += (d2 <= threshold**2).sum(axis=1)
                    cost += np.minimum(d2, threshold**2).sum(axis=1)
                out = pd.DataFrame({"hyp": hyp, "n": n, "cost": cost})
                for i, k in enumerate(keys):
                    out.insert(i, k, rows[k].iloc[0])
                yield out

    tried = matches.select(*keys, *point).join(packed, keys).mapInPandas(count, f"{key_schema}, hyp int, n bigint, cost double")
    score = tried.groupBy(*keys, "hyp").agg(F.sum("n").alias("n"), F.round(F.sum("cost"), 6).alias("cost"))
    return score.join(hyps, [*keys, "hyp"])


def centres(fix: DataFrame, mov: DataFrame, keys=("ds",)) -> DataFrame:
    """Starting translation from the centres of mass of two voxel views."""

    def moments(vox, p):
        total = F.sum("v").cast("double")
        return vox.groupBy(*keys).agg(*[(F.sum(F.col("v") * F.col(a)) / total).alias(f"{p}{a}") for a in "zyx"])

    both = moments(fix, "f").join(moments(mov, "m"), list(keys))
    return both.select(*keys, A.translation(*[F.col(f"m{a}") - F.col(f"f{a}") for a in "zyx"]).alias("m"))


def block_centres(fix: DataFrame, mov: DataFrame, keys=("ds",)) -> DataFrame:
    """As `centres`, of two block tables: every block gives four sums, voxels stay where they are."""

    def moments(blocks: DataFrame, p: str) -> DataFrame:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.select(*keys).schema)

        def run(batches):
            for pdf in batches:
                out = []
                for row in pdf.itertuples(index=False):
                    v = np.asarray(row.v, dtype=float).reshape(B.core_shape(row))
                    at = block_positions(row)
                    out.append([*[getattr(row, k) for k in keys], v.sum(), *[(v * a).sum() for a in at]])
                yield pd.DataFrame(out, columns=[*keys, "t", "z", "y", "x"])

        sums = blocks.select(*keys, *B.BLK, "dims", "bsize", "v").mapInPandas(run, f"{schema}, t double, z double, y double, x double")
        return sums.groupBy(*keys).agg(*[(F.sum(a) / F.sum("t")).alias(f"{p}{a}") for a in "zyx"])

    both = moments(fix, "f").join(moments(mov, "m"), list(keys))
    return both.select(*keys, A.translation(*[F.col(f"m{a}") - F.col(f"f{a}") for a in "zyx"]).alias("m"))


def gradients(fix: DataFrame, keys=("ds",)) -> DataFrame:
    """`fix` with central differences gz, gy, gx of its values, across block faces (half of it at the volume's border)."""
    halo = [1, 1, 1]

    def kernel(arrays, row):
        out = []
        for i in range(3):
            ahead, behind = [[slice(1, -1)] * 3 for _ in range(2)]
            ahead[i], behind[i] = slice(2, None), slice(None, -2)
            out.append((arrays[0][tuple(ahead)] - arrays[0][tuple(behind)]) / 2.0)
        return out

    on = [*keys, *B.BLK]
    grads = B.map_blocks(B.exchange(fix, halo, ("v",), keys), kernel, halo, ("v",), [(f"g{c}", "double") for c in "zyx"], keys)
    return fix.join(grads.select(*on, "gz", "gy", "gx"), on)


def _evaluate(fix, mov, params, dims, bsize, keys, margin):
    """Moment sums of one Gauss-Newton step at the affine `tried` of each key.

    Every step compares the same voxels: those at least `margin` inside the fixed volume and, by the first affine,
    inside the moving one.
    One of them that is mapped outside now counts as the mean, so losing overlap never looks like a better fit.
    """
    target = fix.select(*keys, *B.BLK, "dims", "bsize").join(params.select(*keys, "tried"), list(keys))
    moved = warp(target, mov, dims, bsize, keys, ("v",), affine="tried").withColumnRenamed("v", "w")
    on = [*keys, *B.BLK]
    weight = ["mask"] if "mask" in fix.columns else []
    both = moved.join(fix.select(*on, "v", "gz", "gy", "gx", *weight), on).join(params.select(*keys, "tried", "first"), list(keys))
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fix.select(*keys).schema)
    mid = [(d - 1) / 2.0 for d in dims]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                w, v = np.asarray(row.w).ravel(), np.asarray(row.v).ravel()
                count = np.asarray(row.mask, dtype=float).ravel() if weight else np.ones(w.size)
                at, a = [p.ravel() for p in block_positions(row)], np.asarray(row.tried).reshape(3, 4)
                first = np.asarray(row.first).reshape(3, 4)
                inside = np.ones(w.size, dtype=bool)
                for i, d in enumerate(dims):
                    q, q0 = (b[i, 0] * at[0] + b[i, 1] * at[1] + b[i, 2] * at[2] + b[i, 3] for b in (a, first))
                    inside &= (q >= 0) & (q <= d - 1)
                    for near in (q0, at[i]):
                        count = count * ((near >= margin[i]) & (near <= d - 1 - margin[i]))
                x = [p - c for p, c in zip(at, mid)] + [np.ones(w.size)]
                # the last two parameters are a gain and an offset of the moving values
                j = np.stack([*(np.asarray(g).ravel() * xj for g in (row.gz, row.gy, row.gx) for xj in x), w, np.ones(w.size)])
                r = v - np.where(inside, w, 0.0)
                use = count * inside
                terms = np.concatenate([[(count * r * r).sum(), count.sum()], (j * use) @ r, ((j * use) @ j.T).ravel()])
                out.append({**{k: getattr(row, k) for k in keys}, "s": terms})
            yield pd.DataFrame(out, columns=[*keys, "s"])

    sums = both.mapInPandas(run, f"{key_schema}, s array<double>")
    total = sums.select(*keys, F.posexplode("s").alias("i", "t")).groupBy(*keys, "i").agg(F.sum("t").alias("t"))
    return total.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda e: e["t"]).alias("s"))


def refine_affine(fix: DataFrame, mov: DataFrame, init: DataFrame, dims, bsize, iterations: int = 100,
                  learning_rate: float = 1.0, min_step: float = 1e-3, keys=("ds",), margin=(1, 1, 1)) -> DataFrame:
    """Intensity-based refinement of the affine of each key: keys, m, first_error, error.

    Damped Gauss-Newton with a gain and an offset of the moving values: each iteration is one warp and one aggregate over all keys.  The Jacobian is that of the fixed
    volume, with differences across block faces, made once.  A step that does not lower the error is taken back and damped
    more, so the error never grows.  State is one small row per key, checkpointed per iteration; it ends after `iterations`
    or when no key moves a voxel by `min_step`.  Values are taken against the fixed volume's mean (over the optional `mask`
    column of `fix`, whose other voxels do not count).  `margin`: voxels from either volume's border that are not compared; it should cover what the affine may still move and what smoothing at the border has changed.
    """
    keys = list(keys)
    count = F.aggregate("mask", F.lit(0.0), lambda n, x: n + x.cast("double")) if "mask" in fix.columns else F.size("v").cast("double")
    value = F.zip_with("v", "mask", lambda x, y: x * y.cast("double")) if "mask" in fix.columns else F.col("v")
    mean = fix.groupBy(*keys).agg((F.sum(F.aggregate(value, F.lit(0.0), lambda n, x: n + x)) / F.sum(count)).alias("_mean"))
    centred = [side.join(mean, keys).withColumn("v", F.transform("v", lambda x: x - F.col("_mean"))).drop("_mean") for side in (fix, mov)]
    fix, mov = cut(gradients(cut(centred[0]), keys)), cut(centred[1])
    state = init.select(*keys, F.col("m").alias("tried"), F.col("m").alias("best"), F.col("m").alias("first"), F.lit(None).cast("double").alias("error"),
                        F.lit(None).cast("double").alias("first_error"), F.lit(None).cast("array<double>").alias("s"),
                        F.lit(1e-3).alias("damping"), F.lit(None).cast("double").alias("moved"))
    state = cut(state)
    schema = state.schema
    mid = np.array([(d - 1) / 2.0 for d in dims])
    reach = np.concatenate([np.maximum(mid, 1.0), [1.0]])

    def update(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                s = np.asarray(row.pop("now"))
                right, h = s[2:16], s[16:].reshape(14, 14)
                # what is left after the best gain and offset
                fit = right[12:] @ np.linalg.lstsq(h[12:, 12:], right[12:], rcond=None)[0]
                error = max(s[0] - fit, 0.0) / max(s[1], 1.0)
                if pd.isna(row["error"]) or error < row["error"]:
                    if pd.isna(row["first_error"]):
                        row["first_error"] = error
                    row.update(error=error, best=row["tried"], s=s, damping=max(row["damping"] / 4, 1e-6))
                else:
                    row["damping"] *= 8
                s = np.asarray(row["s"])
                h = s[16:].reshape(14, 14)
                scale = np.diag(h) + 1e-9 * np.trace(h) + 1e-12
                d = learning_rate * np.linalg.solve(h + row["damping"] * np.diag(scale), s[2:16])[:12].reshape(3, 4)
                row["moved"] = float((np.abs(d) * reach).sum(axis=1).max())
                # best o (centre + (I + d) (x - centre))
                inner = np.eye(4)
                inner[:3] += d
                inner[:3, 3] -= d[:, :3] @ mid
                outer = np.vstack([np.asarray(row["best"]).reshape(3, 4), [0, 0, 0, 1]])
                row["tried"] = (outer @ inner)[:3].ravel()
                out.append(row)
            yield pd.DataFrame(out, columns=schema.names)

    for _ in range(iterations):
        sums = _evaluate(fix, mov, state, dims, bsize, keys, margin).withColumnRenamed("s", "now")
        state = cut(state.join(sums, keys).mapInPandas(update, schema))
        if not state.where(F.col("moved") > float(min_step)).head(1):
            break
    return state.select(*keys, F.col("best").alias("m"), "first_error", "error")
