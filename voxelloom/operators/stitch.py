"""Tile stitching: overlapping pairs, pairwise shifts, global placement, fusion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators import blocks as B
from voxelloom.operators import stats as T
from voxelloom.session import written


def overlap_pairs(tiles: DataFrame, cell, keys=("ds",)) -> DataFrame:
    """Pairs of tiles whose boxes intersect, with the common box.

    `tiles`: keys, tile_id, y0, x0, h, w.  Tiles are listed under the grid cells they
    cover; a pair is reported by the one cell that holds the common box's lower corner,
    so the join is on cells and needs no clean-up.
    """
    t = tiles
    for a, s, n in (("y", "h", cell[0]), ("x", "w", cell[1])):
        lo, hi = F.floor(F.col(f"{a}0") / int(n)), F.floor((F.col(f"{a}0") + F.col(s) - 1) / int(n))
        t = t.withColumn(f"c{a}", F.explode(F.sequence(lo, hi)))
    cols = ("tile_id", "y0", "x0", "h", "w")
    a = t.select(*keys, "cy", "cx", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = t.select(*keys, "cy", "cx", *[F.col(c).alias(f"b_{c}") for c in cols])
    df = a.join(b, [*keys, "cy", "cx"]).where("a_tile_id < b_tile_id")
    df = df.withColumns({
        "lo_y": F.greatest("a_y0", "b_y0"), "hi_y": F.least(F.expr("a_y0 + a_h"), F.expr("b_y0 + b_h")),
        "lo_x": F.greatest("a_x0", "b_x0"), "hi_x": F.least(F.expr("a_x0 + a_w"), F.expr("b_x0 + b_w")),
    }).where("hi_y > lo_y and hi_x > lo_x")
    df = df.where((F.floor(F.col("lo_y") / int(cell[0])) == F.col("cy")) & (F.floor(F.col("lo_x") / int(cell[1])) == F.col("cx")))
    return df.drop("cy", "cx")


def lines(vox: DataFrame, keys=("ds",)) -> DataFrame:
    """Tile voxels as lines along x from 0: keys, tile_id, z, y, line array<double>; voxels that are not stored are 0."""
    g = vox.groupBy(*keys, "tile_id", "z", "y").agg(F.array_sort(F.collect_list(F.struct("x", F.col("v").cast("double").alias("v")))).alias("l"))
    last = F.element_at("l", -1)["x"]
    by_x = F.map_from_entries("l")
    filled = F.transform(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")), lambda i: F.coalesce(by_x[i.cast(vox.schema["x"].dataType)], F.lit(0.0)))
    return g.select(*keys, "tile_id", "z", "y", F.when(F.size("l") == last + 1, F.col("l.v")).otherwise(filled).alias("line"))


def shift_scores(pairs: DataFrame, vox: DataFrame, reach: int, keys=("ds",)) -> DataFrame:
    """Correlation of each pair for every in-plane shift up to `reach`.

    For shift s voxel g of the first tile meets voxel g + s of the second.  Lines of
    both tiles are joined per row shift and cut for each column shift; only the moment
    sums of a line leave its task, so a pair's size is no limit.
    """
    ln = lines(vox, keys)
    meta = ["a_tile_id", "b_tile_id", "a_y0", "a_x0", "b_y0", "b_x0", "b_h", "b_w", "lo_y", "hi_y", "lo_x", "hi_x"]
    p = pairs.select(*keys, *meta)
    a = p.join(ln.select(*keys, F.col("tile_id").alias("a_tile_id"), "z", F.col("y").alias("ya"), F.col("line").alias("la")),
               [*keys, "a_tile_id"])
    a = a.withColumn("gy", F.col("ya") + F.col("a_y0")).where("gy >= lo_y and gy < hi_y")
    shifts = F.sequence(F.lit(-reach).cast("bigint"), F.lit(reach).cast("bigint"))
    a = a.withColumn("sy", F.explode(shifts)).withColumn("yb", F.expr("gy + sy - b_y0")).where("yb >= 0 and yb < b_h")
    b = ln.select(*keys, F.col("tile_id").alias("b_tile_id"), "z", F.col("y").alias("yb"), F.col("line").alias("lb"))
    both = a.join(b, [*keys, "b_tile_id", "z", "yb"]).withColumn("sx", F.explode(shifts))
    both = both.withColumns({"g0": F.greatest(F.col("lo_x"), F.expr("b_x0 - sx")), "g1": F.least(F.col("hi_x"), F.expr("b_x0 + b_w - sx"))})
    both = both.where("g1 > g0").withColumns({
        "va": F.slice("la", F.expr("int(g0 - a_x0 + 1)"), F.expr("int(g1 - g0)")),
        "vb": F.slice("lb", F.expr("int(g0 + sx - b_x0 + 1)"), F.expr("int(g1 - g0)")),
    })
    sums = both.select(*keys, "a_tile_id", "b_tile_id", "sy", "sx", T.pair_sums("va", "vb").alias("s"))
    sums = sums.groupBy(*keys, "a_tile_id", "b_tile_id", "sy", "sx").agg(*[F.sum(f"s.{c}").alias(c) for c in T.SUMS])
    return sums.withColumn("r", T.corr_of_sums())


def best_shift(scores: DataFrame, keys=("ds",)) -> DataFrame:
    """The shift with the highest correlation; ties go to the smallest shift."""
    r = F.round("r", 6)
    rank = F.struct(r.alias("r"), (-(F.abs("sy") + F.abs("sx"))).alias("d"), (-F.col("sy")).alias("y"), (-F.col("sx")).alias("x"))
    best = F.max_by(F.struct("sy", "sx", r.alias("r"), F.col("n").cast("bigint").alias("n")), rank)
    g = scores.where("r is not null").groupBy(*keys, "a_tile_id", "b_tile_id").agg(best.alias("b"))
    return g.select(*keys, "a_tile_id", "b_tile_id", "b.*")


def filter_links(links: DataFrame, min_r: float) -> DataFrame:
    return links.where(F.col("r") >= float(min_r))


def solve_places(tile: np.ndarray, a: np.ndarray, b: np.ndarray, shift: np.ndarray, fixed: int, tolerance: float) -> np.ndarray:
    """Least-squares positions of tiles from links pos[a] - pos[b] = shift, by conjugate gradients over sparse links."""
    at = {int(t): i for i, t in enumerate(tile)}
    i, j = (np.array([at[int(t)] for t in side], dtype=np.int64) for side in (a, b))
    n, free = len(tile), np.where(tile == fixed, 0.0, 1.0)
    degree = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
    out = np.zeros((n, shift.shape[1]))
    for c in range(shift.shape[1]):
        def product(p):
            return free * (degree * p - np.bincount(i, p[j], n) - np.bincount(j, p[i], n))

        x = np.zeros(n)
        r = free * (np.bincount(i, shift[:, c], n) - np.bincount(j, shift[:, c], n))
        p, now = r.copy(), float(r @ r)
        least = now * tolerance**2
        while now > least:
            q = product(p)
            along = float(p @ q)
            if along <= 0:
                break
            x += now / along * p
            r -= now / along * q
            last, now = now, float(r @ r)
            p = r + now / last * p
        out[:, c] = x
    return out


#: Datasets of so many links at most are solved in one task each; its memory is bounded by that.
SMALL_LINKS = 1 << 18


def place(tiles: DataFrame, links: DataFrame, keys=("ds",), fixed: int = 0, tolerance: float = 1e-10) -> DataFrame:
    """Corrections (dy, dx) per tile: the least-squares solution of all links.

    A link says that content of tile a at g lies at g + s in tile b, so the corrected positions differ by -s.  Tile `fixed`
    does not move; tiles that no chain of links joins to it keep a mean correction of 0; links to tiles that are not listed do not
    count.  Only tile and link rows are read (a few numbers each, no pixels).  If a dataset has more than SMALL_LINKS links, all
    are solved by conjugate gradients in Spark rounds: a join of links and tiles, grouped sums, one written table a round.
    """
    keys = list(keys)
    both = links.select(*keys, "a_tile_id", "b_tile_id", F.col("sy").cast("double").alias("sy"), F.col("sx").cast("double").alias("sx"))
    both = both.join(tiles.select(*keys, F.col("tile_id").alias("a_tile_id")), [*keys, "a_tile_id"], "left_semi")
    both = written(both.join(tiles.select(*keys, F.col("tile_id").alias("b_tile_id")), [*keys, "b_tile_id"], "left_semi"), "links")
    if both.groupBy(*keys).count().where(F.col("count") > SMALL_LINKS).head(1):
        return _place_rounds(tiles.select(*keys, "tile_id").distinct(), both, keys, fixed, tolerance)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tiles.select(*keys, "tile_id").schema) + ", dy double, dx double"

    def solve(mine: pd.DataFrame, linked: pd.DataFrame) -> pd.DataFrame:
        if mine.empty:
            return pd.DataFrame(columns=[*keys, "tile_id", "dy", "dx"])
        tile = np.unique(mine["tile_id"].to_numpy())
        found = solve_places(tile, *(linked[c].to_numpy() for c in ("a_tile_id", "b_tile_id")), linked[["sy", "sx"]].to_numpy(float), fixed, tolerance)
        return pd.DataFrame({**{k: mine[k].iloc[0] for k in keys}, "tile_id": tile, "dy": found[:, 0], "dx": found[:, 1]})

    grouped = tiles.select(*keys, "tile_id").groupBy(*keys).cogroup(both.groupBy(*keys))
    return grouped.applyInPandas(solve, schema)


def _place_rounds(tiles: DataFrame, links: DataFrame, keys, fixed: int, tolerance: float) -> DataFrame:
    """`place` by Spark rounds; y and x are two systems with steps of their own, all datasets go on together."""
    one, both = [*keys, "tile_id"], ("y", "x")
    ends = links.select(*keys, F.col("a_tile_id").alias("tile_id"), F.col("b_tile_id").alias("other"), *[F.col(f"s{c}") for c in both])
    ends = ends.unionByName(links.select(*keys, F.col("b_tile_id").alias("tile_id"), F.col("a_tile_id").alias("other"), *[(-F.col(f"s{c}")).alias(f"s{c}") for c in both]))
    ends = written(ends, "ends")
    start = ends.groupBy(*one).agg(F.count("*").cast("double").alias("degree"), *[F.sum(f"s{c}").alias(f"s{c}") for c in both])
    free = F.when(F.col("tile_id") == fixed, 0.0).otherwise(1.0)
    state = tiles.join(start, one, "left").select(*one, free.alias("free"), F.coalesce("degree", F.lit(0.0)).alias("degree"),
                                                  *[(free * F.coalesce(f"s{c}", F.lit(0.0))).alias(f"r{c}") for c in both])
    state = written(state.select("*", *[F.lit(0.0).alias(f"x{c}") for c in both], *[F.col(f"r{c}").alias(f"p{c}") for c in both]), "state")
    first = written(state.groupBy(*keys).agg(*[F.sum(F.col(f"r{c}") * F.col(f"r{c}")).alias(f"first{c}") for c in both]), "first")
    while True:
        near = ends.join(state.select(*keys, F.col("tile_id").alias("other"), "py", "px"), [*keys, "other"])
        near = near.groupBy(*one).agg(*[F.sum(f"p{c}").alias(f"n{c}") for c in both])
        held = state.join(near, one, "left").select(
            *state.columns, *[(F.col("free") * (F.col("degree") * F.col(f"p{c}") - F.coalesce(f"n{c}", F.lit(0.0)))).alias(f"q{c}") for c in both])
        held = written(held, "rounds")
        dots = held.groupBy(*keys).agg(*[F.sum(F.col(f"r{c}") * F.col(f"r{c}")).alias(f"rr{c}") for c in both],
                                       *[F.sum(F.col(f"p{c}") * F.col(f"q{c}")).alias(f"pq{c}") for c in both])
        step = dots.select(*keys, "rry", "rrx", *[F.when(F.col(f"pq{c}") > 0, F.col(f"rr{c}") / F.col(f"pq{c}")).otherwise(0.0).alias(f"a{c}") for c in both])
        moved = held.join(step, keys).select(*one, "free", "degree", "rry", "rrx", *[(F.col(f"x{c}") + F.col(f"a{c}") * F.col(f"p{c}")).alias(f"x{c}") for c in both],
                                             *[(F.col(f"r{c}") - F.col(f"a{c}") * F.col(f"q{c}")).alias(f"r{c}") for c in both], "py", "px", "ay", "ax")
        after = moved.groupBy(*keys).agg(*[F.sum(F.col(f"r{c}") * F.col(f"r{c}")).alias(f"now{c}") for c in both],
                                         F.max(F.greatest("ay", "ax")).alias("went"))
        state = moved.join(after, keys).select(*one, "free", "degree", "ry", "rx", "xy", "xx", *[
            (F.col(f"r{c}") + F.when(F.col(f"rr{c}") > 0, F.col(f"now{c}") / F.col(f"rr{c}")).otherwise(0.0) * F.col(f"p{c}")).alias(f"p{c}") for c in both])
        going = after.join(first, keys).where("went > 0").where(" or ".join(f"now{c} > first{c} * {tolerance ** 2}" for c in both))
        if not going.head(1):
            return state.select(*one, F.col("xy").alias("dy"), F.col("xx").alias("dx"))


def fuse(vox: DataFrame, tiles: DataFrame, keys=("ds",)) -> DataFrame:
    """One volume from placed tiles (keys, tile_id, y0, x0, h, w): mean weighted by the
    distance to the tile's border; one shuffle, combined map-side."""
    df = vox.join(tiles.select(*keys, "tile_id", "y0", "x0", "h", "w"), [*keys, "tile_id"])
    w = F.least(F.col("y") + 1, F.col("h") - F.col("y")) * F.least(F.col("x") + 1, F.col("w") - F.col("x"))
    return df.groupBy(*keys, "z", (F.col("y") + F.col("y0")).alias("y"), (F.col("x") + F.col("x0")).alias("x")).agg(
        (F.sum(w * F.col("v")) / F.sum(w)).alias("v"))


def overlap_boxes(tiles: DataFrame, cell, keys=("ds",)) -> DataFrame:
    """Pairs of tiles whose boxes intersect in three axes: a_* and b_* of both, lo_*, hi_* of the common box.

    `tiles`: keys, tile_id, z0, y0, x0, d, h, w.  As `overlap_pairs`: a pair is reported by the one grid cell that holds the
    common box's lower corner.
    """
    t, axes = tiles, list(zip("zyx", "dhw", cell))
    for a, s, n in axes:
        t = t.withColumn(f"c{a}", F.explode(F.sequence(F.floor(F.col(f"{a}0") / int(n)), F.floor((F.col(f"{a}0") + F.col(s) - 1) / int(n)))))
    cols, at = ("tile_id", *[f"{a}0" for a in "zyx"], *"dhw"), [f"c{a}" for a in "zyx"]
    one, other = (t.select(*keys, *at, *[F.col(c).alias(f"{side}_{c}") for c in cols]) for side in "ab")
    df = one.join(other, [*keys, *at]).where("a_tile_id < b_tile_id")
    for a, s, n in axes:
        df = df.withColumns({f"lo_{a}": F.greatest(f"a_{a}0", f"b_{a}0"), f"hi_{a}": F.least(F.expr(f"a_{a}0 + a_{s}"), F.expr(f"b_{a}0 + b_{s}"))})
        df = df.where((F.col(f"hi_{a}") > F.col(f"lo_{a}")) & (F.floor(F.col(f"lo_{a}") / int(n)) == F.col(f"c{a}")))
    return df.drop(*at)


def gather(wanted: DataFrame, blocks: DataFrame, bsize, ids, keys=("ds",)) -> DataFrame:
    """The boxes [l0..l2, h0..h2) of `wanted` cut out of a block table: ids, part_box, part_v; blocks are cut before the shuffle.

    `keys` join both sides, `ids` name a wanted box.
    """
    cut_at = wanted.select(*dict.fromkeys([*keys, *ids]), *[f"{c}{i}" for c in "lh" for i in range(3)])
    for i, (b, n) in enumerate(zip(B.BLK, bsize)):
        cut_at = cut_at.withColumn(b, F.explode(F.sequence(F.floor(F.col(f"l{i}") / int(n)), F.floor((F.col(f"h{i}") - 1) / int(n)))))
    got = cut_at.join(blocks.select(*keys, *B.BLK, "dims", "v"), [*keys, *B.BLK])
    for i, (b, n) in enumerate(zip(B.BLK, bsize)):
        got = got.withColumns({f"_a{i}": F.col(b) * int(n), f"_b{i}": F.least(F.col(b) * int(n) + int(n), F.col("dims")[i])})
        got = got.withColumns({f"_lo{i}": F.greatest(f"l{i}", f"_a{i}"), f"_hi{i}": F.least(f"h{i}", f"_b{i}")})
    got = got.where(" and ".join(f"_hi{i} > _lo{i}" for i in range(3)))
    box = F.array(*[F.col(f"_lo{i}") - F.col(f"l{i}") for i in range(3)], *[F.col(f"_hi{i}") - F.col(f"_lo{i}") for i in range(3)])
    parts = got.select(*ids, F.struct(box.alias("box"), B.slab("v").alias("v")).alias("p")).groupBy(*ids).agg(F.collect_list("p").alias("p"))
    return parts.select(*ids, F.flatten("p.box").alias("part_box"), F.flatten("p.v").alias("part_v"))


def _filled(shape, boxes, data) -> np.ndarray:
    out, at, data = np.zeros(shape), 0, np.asarray(data, dtype=float)
    for box in np.asarray(boxes, dtype=np.int64).reshape(-1, 6):
        n = int(np.prod(box[3:]))
        out[tuple(slice(a, a + k) for a, k in zip(box[:3], box[3:]))] = data[at:at + n].reshape(box[3:])
        at += n
    return out


def moment_volumes(f: np.ndarray, m: np.ndarray, real: np.ndarray, reach) -> np.ndarray:
    """(6, shifts): count and moment sums of `f` against `m`, which is larger by `reach` on both sides, for every shift.

    All shifts at once as products of Fourier transforms; `real` marks the voxels of `m` that exist.
    """
    size = [a + b - 1 for a, b in zip(f.shape, m.shape)]
    one = f.mean()  # shifted values keep the sums small; corrected below
    a, b = f - one, np.where(real, m - one, 0.0)
    wide = [np.fft.rfftn(x, size, (0, 1, 2)) for x in (real.astype(float), b, b * b)]
    window = tuple(slice(0, 2 * r + 1) for r in reach)

    def sums(g, i):
        return np.fft.irfftn(np.conj(np.fft.rfftn(g, size, (0, 1, 2))) * wide[i], size, (0, 1, 2))[window].ravel()

    unit = np.ones_like(f)
    n = np.rint(sums(unit, 0))
    sa, sb, saa, sbb, sab = sums(a, 0), sums(unit, 1), sums(a * a, 0), sums(unit, 2), sums(a, 1)
    # back to the values as they are
    return np.stack([n, sa + one * n, sb + one * n, saa + 2 * one * sa + one * one * n, sbb + 2 * one * sb + one * one * n, sab + one * (sa + sb) + one * one * n])


def shift_volumes(pairs: DataFrame, blocks: DataFrame, bsize, reach, chunk=(16, 32, 32), keys=("ds",)) -> DataFrame:
    """Correlation of each pair of tiles for every shift (sz, sy, sx) up to `reach` per axis.

    `pairs`: from `overlap_boxes`; `blocks`: keys, tile_id, block id, dims, bsize, v in a tile's own coordinates.  Voxel g of the
    first tile meets voxel g + s of the second.  The common box is taken in chunks: a chunk and its neighbourhood in the second
    tile meet in a task, Fourier transforms give the moment sums of all its shifts, and sums add up over the chunks of a pair.
    """
    reach, names = [int(r) for r in reach], [*keys, "a_tile_id", "b_tile_id"]
    ids = [*names, "k0", "k1", "k2"]
    df = pairs
    for i, (a, n) in enumerate(zip("zyx", chunk)):
        df = df.withColumn(f"k{i}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(f"hi_{a}") - F.col(f"lo_{a}") - 1) / int(n)))))
        df = df.withColumn(f"g{i}", F.col(f"lo_{a}") + F.col(f"k{i}") * int(n))
        df = df.withColumn(f"e{i}", F.least(F.col(f"g{i}") + int(n), F.col(f"hi_{a}")))
    sides = {}
    for side, far in (("a", [0, 0, 0]), ("b", reach)):
        low = [F.col(f"g{i}") - F.col(f"{side}_{a}0") - r for i, (a, r) in enumerate(zip("zyx", far))]
        high = [F.col(f"e{i}") - F.col(f"{side}_{a}0") + r for i, (a, r) in enumerate(zip("zyx", far))]
        box = df.select(*keys, "a_tile_id", "b_tile_id", "k0", "k1", "k2", F.col(f"{side}_tile_id").alias("tile_id"),
                        *[c.cast("bigint").alias(f"l{i}") for i, c in enumerate(low)], *[c.cast("bigint").alias(f"h{i}") for i, c in enumerate(high)])
        parts = gather(box, blocks, bsize, ids, [*keys, "tile_id"])
        sides[side] = parts.select(*ids, F.col("part_box").alias(f"box_{side}"), F.col("part_v").alias(f"v_{side}"))
    limits = [F.array(*[(F.col(f"b_{c}0") if what == "0" else F.col(f"b_{c}0") + F.col(f"b_{s}")).cast("bigint") for c, s in zip("zyx", "dhw")]) for what in "01"]
    both = df.select(*ids, F.array(*[F.col(f"g{i}").cast("bigint") for i in range(3)]).alias("low"), F.array(*[F.col(f"e{i}").cast("bigint") for i in range(3)]).alias("high"),
                     limits[0].alias("first"), limits[1].alias("last")).join(sides["a"], ids).join(sides["b"], ids)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*names).schema)
    shifts = np.stack(np.unravel_index(np.arange(int(np.prod([2 * r + 1 for r in reach]))), [2 * r + 1 for r in reach]), 1) - reach

    def made(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                low, high = (np.asarray(x, dtype=np.int64) for x in (row.low, row.high))
                f = _filled(high - low, row.box_a, row.v_a)
                m = _filled(high - low + 2 * np.array(reach), row.box_b, row.v_b)
                real = np.ones(m.shape, dtype=bool)
                for ax in range(3):  # the second tile ends somewhere
                    at = np.arange(m.shape[ax]) + low[ax] - reach[ax]
                    real &= np.expand_dims((at >= row.first[ax]) & (at < row.last[ax]), [i for i in range(3) if i != ax])
                out = dict(zip(T.SUMS, moment_volumes(f, m, real, reach)))
                yield [getattr(row, c) for c in names], {**out, **dict(zip(("sz", "sy", "sx"), shifts.T))}

    def run(batches):
        return B.together(made(batches), [*T.SUMS, "sz", "sy", "sx"], names)

    sums = both.mapInPandas(run, f"{schema}, " + ", ".join(f"{c} double" for c in T.SUMS) + ", sz bigint, sy bigint, sx bigint")
    sums = sums.groupBy(*names, "sz", "sy", "sx").agg(*[F.sum(c).alias(c) for c in T.SUMS]).where("n > 0.5")
    spread = F.col("n") * F.greatest(F.abs("saa"), F.abs("sbb")) * 1e-9  # flat but for the rounding of the transforms
    va, vb = (F.col("n") * F.col(f"s{c}{c}") - F.col(f"s{c}") * F.col(f"s{c}") for c in "ab")
    return sums.withColumn("r", F.when((va > spread) & (vb > spread), T.corr_of_sums()))


def best_shift_volume(scores: DataFrame, least: int = 2, keys=("ds",)) -> DataFrame:
    """The shift (sz, sy, sx) with the highest correlation over `least` voxels or more; ties go to the smallest shift."""
    r = F.round("r", 5)
    away = F.abs("sz") + F.abs("sy") + F.abs("sx")
    rank = F.struct(r.alias("r"), (-away).alias("d"), *[(-F.col(c)).alias(f"_{c}") for c in ("sz", "sy", "sx")])
    best = F.max_by(F.struct("sz", "sy", "sx", r.alias("r"), F.round("n").cast("bigint").alias("n")), rank)
    g = scores.where(F.col("r").isNotNull() & (F.col("n") >= int(least))).groupBy(*keys, "a_tile_id", "b_tile_id").agg(best.alias("b"))
    return g.select(*keys, "a_tile_id", "b_tile_id", "b.*")
