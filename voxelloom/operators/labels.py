"""Block-wise segmentation, label merging across blocks, size filter, renumbering.

Labels are kept in block tables (`v array<bigint>`, 0 = background).  Changes of labels
travel as small rows (block, old, new) to the blocks that hold them; voxels stay put.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from voxelloom.operators import blocks as B
from voxelloom.operators import filters as N
from voxelloom.operators.manifest import rank_in_group
from voxelloom.session import cut

#: Segmentation models: name -> fn(array, params) -> array of local labels (0 = none).
MODELS: dict[str, Callable] = {}


def model(name: str):
    """Register a block segmentation function under a name."""

    def add(fn):
        MODELS[name] = fn
        return fn

    return add


def connected(mask: np.ndarray, in_plane: bool = False, labels: np.ndarray | None = None) -> np.ndarray:
    """Face-connected components of a block, of voxels with one label where `labels` are given; label = 1 + smallest index
    of the component."""
    index = np.arange(mask.size).reshape(mask.shape)
    pairs = []
    for ax in (1, 2) if in_plane else (0, 1, 2):
        low = tuple(slice(0, -1) if i == ax else slice(None) for i in range(3))
        high = tuple(slice(1, None) if i == ax else slice(None) for i in range(3))
        both = mask[low] & mask[high]
        if labels is not None:
            both &= labels[low] == labels[high]
        pairs.append((index[low][both], index[high][both]))
    a, b = (np.concatenate([p[i] for p in pairs]) for i in range(2))
    root = index.ravel().copy()
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            break
        m = np.minimum(ra, rb)
        np.minimum.at(root, ra[differ], m[differ])
        np.minimum.at(root, rb[differ], m[differ])
        while (root[root] != root).any():
            root = root[root]
    return np.where(mask, root.reshape(mask.shape) + 1, 0)


@model("threshold")
def threshold_model(a: np.ndarray, params) -> np.ndarray:
    """Components of the voxels above `threshold` (a number, or a column of the block)."""
    return connected(a > params["threshold"], params.get("in_plane", False))


def segment(blocks: DataFrame, name: str = "threshold", overlap=(0, 0, 0), keys=("ds",), per_key: DataFrame | None = None,
            smooth: float = 0.0, around: bool = False, **params) -> DataFrame:
    """Run a model on each block extended by `overlap`; keep the labels of its core.

    `per_key` adds columns (say a threshold per dataset) that override `params`.
    `smooth` is the sigma of the optional smoothing before the model.  A label becomes
    1 + the smallest linear voxel id it has in its block, which is unique in the volume.
    With `around` the column `w` holds the labels of the extended block (clipped to the
    volume), for `merge_overlap`; objects that do not reach the core are 0 there.
    """
    fn, soft = MODELS[name], N.radius(smooth)
    halo = [int(o) + soft for o in overlap]
    extra = [c for c in (per_key.columns if per_key is not None else []) if c not in keys]

    def kernel(arrays, row):
        a = N.smooth_array(arrays[0], [smooth] * 3) if smooth else arrays[0]
        # Beyond the volume border there is nothing to segment.
        org, core = B.core_origin(row), B.core_shape(row)
        before = [max(int(v) - o, 0) for v, o in zip(overlap, org)]
        after = [max(o + c + int(v) - int(d), 0) for o, c, v, d in zip(org, core, overlap, row.dims)]
        a = a[tuple(slice(b, s - e) for b, s, e in zip(before, a.shape, after))]
        labels = fn(a, {**params, **{c: getattr(row, c) for c in extra}})
        start = [int(v) - b for v, b in zip(overlap, before)]
        inner = labels[tuple(slice(s, s + c) for s, c in zip(start, core))]
        ids = global_ids(inner, org, row.dims)
        return [ids, renamed(labels, inner, ids)] if around else [ids]

    parts = B.exchange(blocks, halo, ("v",), keys)
    if per_key is not None:
        parts = parts.join(per_key, list(keys))
    return B.map_blocks(parts, kernel, halo, ("v",), [(c, "bigint") for c in ("v", "w")[:1 + around]], keys)


def renamed(labels: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """`labels` with each label of `old` replaced by the one at the same place of `new`; others become 0."""
    known, first = np.unique(old.ravel(), return_index=True)
    at = np.minimum(np.searchsorted(known, labels), len(known) - 1)
    return np.where((known[at] == labels) & (labels != 0), new.ravel()[first][at], 0)


def global_ids(labels: np.ndarray, org, dims) -> np.ndarray:
    """Replace local labels by 1 + the smallest linear voxel id of each."""
    z, y, x = [np.arange(o, o + n, dtype=np.int64) for o, n in zip(org, labels.shape)]
    ny, nx = int(dims[1]), int(dims[2])
    ids = (z[:, None, None] * ny + y[None, :, None]) * nx + x[None, None, :] + 1
    _, first, back = np.unique(labels.ravel(), return_index=True, return_inverse=True)
    # Voxels are in linear order, so the first one of a label has the smallest id.
    return np.where(labels != 0, ids.ravel()[first][back].reshape(labels.shape), 0)


def touching(labels: DataFrame, keys=("ds",), in_plane: bool = False) -> tuple[DataFrame, DataFrame]:
    """Labels that meet across block faces.

    Returns the edges (keys, a, b) and where the labels live (keys, label, block id).
    Only face voxels leave the block.
    """

    def faces(arrays, row):
        a, org, core = arrays[0], B.core_origin(row), B.core_shape(row)
        made = {n: [] for n in ("axis", "z", "y", "x", "side", "label")}
        for ax in (1, 2) if in_plane else (0, 1, 2):
            for side, at in ((0, core[ax] - 1), (1, 0)):
                if (side == 0 and org[ax] + core[ax] >= int(row.dims[ax])) or (side == 1 and org[ax] == 0):
                    continue
                face = np.take(a, [at], axis=ax)
                pos = np.argwhere(face != 0)
                where = [pos[:, i] + org[i] for i in range(3)]
                where[ax] = where[ax] + (at if side == 0 else -1)
                made["axis"].append(np.full(len(pos), ax))
                made["side"].append(np.full(len(pos), side))
                made["label"].append(face[face != 0])
                for n, w in zip("zyx", where):
                    made[n].append(w)
        out = {n: np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for n, v in made.items()}
        return {**out, **{b: np.full(len(out["z"]), getattr(row, b)) for b in B.BLK}}

    schema = "axis int, z bigint, y bigint, x bigint, side int, label bigint, blk_z bigint, blk_y bigint, blk_x bigint"
    def homes(arrays, row):
        """The labels on the faces that `faces` sends, once each."""
        found = np.unique(faces(arrays, row)["label"])
        return {"label": found, **{b: np.full(len(found), getattr(row, b)) for b in B.BLK}}

    rows = B.map_block_rows(as_parts(labels, keys), faces, schema, keys=keys)
    side = [F.max(F.when(F.col("side") == s, F.col("label"))) for s in (0, 1)]
    pairs = rows.groupBy(*keys, "axis", "z", "y", "x").agg(side[0].alias("a"), side[1].alias("b"))
    edges = pairs.where("a is not null and b is not null and a <> b").select(*keys, "a", "b").distinct()
    places = B.map_block_rows(as_parts(labels, keys), homes, "label bigint, blk_z bigint, blk_y bigint, blk_x bigint", keys=keys)
    return edges, places.distinct()


def as_parts(blocks: DataFrame, keys=("ds",), col="v") -> DataFrame:
    """A block table in the layout of an exchange without halo (no shuffle)."""
    org = [F.col(b) * F.col("bsize")[i] for i, b in enumerate(B.BLK)]
    size = [F.least(F.col("bsize")[i], F.col("dims")[i] - o) for i, o in enumerate(org)]
    return blocks.select(*keys, *B.BLK, "dims", "bsize", F.array(*org, *size).alias("part_box"), F.col(col).alias(f"part_{col}"))


#: A key's graph of so many edges is solved in one task; its memory is bounded by that.
SMALL_GRAPH = 1 << 20
#: Edges that a task holds before it contracts them.
HELD_EDGES = 1 << 18


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots) of the edges a-b: the smallest node that each one reaches."""
    nodes, back = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = back[:len(a)], back[len(a):]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def components(edges: DataFrame, keys=("ds",)) -> DataFrame:
    """Connected components of a graph: keys, label, root (the smallest label).

    Every task first contracts runs of its own edges to stars.  Keys are graphs of their own: one of which at most SMALL_GRAPH edges
    are left is solved in one task, all of these in one shuffle.  Larger ones by alternating star contraction, whose number of
    rounds grows with the logarithm of the graph's size and whose rounds are joins and minima only.  Every round is checkpointed;
    its checksum comes from the writing job.
    """
    keys = list(keys)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.select(*keys).schema)
    schema += ", a bigint, b bigint"

    def stars(rows):
        import pandas as pd

        for key, rows in rows.groupby(keys, sort=False, dropna=False):
            nodes, roots = _roots(rows["a"].to_numpy(), rows["b"].to_numpy())
            out = pd.DataFrame({"a": nodes, "b": roots})[nodes != roots]
            for i, (name, value) in enumerate(zip(keys, key if isinstance(key, tuple) else (key,))):
                out.insert(i, name, value)
            yield out

    def contract(batches):
        import pandas as pd

        held, n = [], 0
        for pdf in batches:
            for at in range(0, len(pdf), HELD_EDGES):
                held.append(pdf.iloc[at:at + HELD_EDGES])
                n += len(held[-1])
                if n >= HELD_EDGES:
                    rows, held, n = pd.concat(held), [], 0
                    yield from stars(rows)
        if held:
            yield from stars(pd.concat(held))

    def solve(pdf):
        import pandas as pd

        return pd.concat([pdf[:0], *stars(pdf)])

    def rooted(edges):
        roots = edges.select(*keys, F.col("b").alias("label"), F.col("b").alias("root")).distinct()
        return roots.unionByName(edges.select(*keys, F.col("a").alias("label"), F.col("b").alias("root")))

    edges = cut(edges.select(*keys, "a", "b").mapInPandas(contract, schema))
    large = edges.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > SMALL_GRAPH).drop("_n")
    large = large.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    if not large.head(1):
        return rooted(cut(edges.groupBy(*keys).applyInPandas(solve, schema)))
    small = rooted(cut(edges.join(large, same, "left_anti").groupBy(*keys).applyInPandas(solve, schema)))
    edges = edges.join(large, same, "left_semi")
    seen = None
    while True:
        both = edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, [*keys, "a"]).where("b > a").select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        hub = large.join(low, [*keys, "a"])
        low = hub.where("b <> m").select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        seal = Observation()
        met = low.unionByName(hub.select(*keys, "a", F.col("m").alias("b"))).distinct()
        edges = cut(met.observe(seal, F.count("*").alias("n"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)")).alias("h")))
        mark = seal.get
        if mark == seen:
            break
        seen = mark
    return small.unionByName(rooted(edges))


def relabel(labels: DataFrame, changes: DataFrame, keys=("ds",)) -> DataFrame:
    """Apply (keys, block id, label, new) rows; labels that are not listed stay."""
    on = [*keys, *B.BLK]
    c = changes.groupBy(*on).agg(F.collect_list(F.struct("label", "new")).alias("c"))
    df = labels.join(c, on, "left").select(*on, "dims", "bsize", "v", F.col("c.label").alias("old"), F.col("c.new").alias("new"))
    keep = labels.select(*on, "dims", "bsize", "v").schema

    def run(batches):
        for pdf in batches:
            out = []
            for v, old, new in zip(pdf["v"], pdf["old"], pdf["new"]):
                v = np.asarray(v, dtype=np.int64)
                if old is not None and len(old):
                    order = np.argsort(old)
                    old, new = np.asarray(old)[order], np.asarray(new)[order]
                    at = np.clip(np.searchsorted(old, v), 0, len(old) - 1)
                    v = np.where(old[at] == v, new[at], v)
                out.append(v)
            yield pdf.drop(columns=["old", "new"]).assign(v=out)

    return df.mapInPandas(run, keep)


def merge(labels: DataFrame, keys=("ds",), in_plane: bool = False, mask: DataFrame | None = None) -> DataFrame:
    """One label per object across all blocks: the smallest of those that touch.

    With `mask` (block table, column `m`; a block without one is outside) labels outside it become 0 first, and labels that
    fall apart by that are split, so the result does not depend on the block size.
    """
    if mask is not None:
        on = [*keys, *B.BLK]
        zeroed = F.zip_with("v", "m", lambda v, m: F.when(m != 0, v).otherwise(F.lit(0).cast("bigint")))
        zeroed = F.coalesce(zeroed, F.transform("v", lambda v: F.lit(0).cast("bigint")))
        labels = labels.join(mask.select(*on, "m"), on, "left").withColumn("v", zeroed).drop("m")

        def split(arrays, row):
            a = arrays[0]
            return [global_ids(connected(a != 0, in_plane, a), B.core_origin(row), row.dims)]

        labels = B.map_blocks(as_parts(labels, keys), split, (0, 0, 0), ("v",), [("v", "bigint")], keys)
    labels = cut(labels)  # the model's output is used three times
    edges, places = touching(labels, keys, in_plane)
    roots = components(edges, keys).where("label <> root")
    changes = places.join(roots, [*keys, "label"]).withColumnRenamed("root", "new")
    return relabel(labels, changes, keys)


def overlaps(segmented: DataFrame, overlap, keys=("ds",)) -> DataFrame:
    """What neighbouring blocks both segmented: keys, the two block ids (blk_*, far_*), a, b, n, na, nb.

    a is a label of the first block, b one of the second; n voxels have both, na and nb have the one or the other.  Counted
    where one block's core lies within `overlap` of the other: the second column `w` of `segment` with `around`.  A block sends
    its labels there to the (at most 26) pairs it is part of, one shuffle; a pair holds two slabs.
    """
    if any(int(o) < 0 for o in overlap):
        raise ValueError("overlap must not be negative")
    far = ["far_z", "far_y", "far_x"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in segmented.select(*keys, *B.BLK).schema)
    schema += "".join(f", {c} bigint" for c in far)

    def reach(at, row):
        """Core and extended box of a block: (first, end) per axis."""
        core = [(i * int(s), min(i * int(s) + int(s), int(d))) for i, s, d in zip(at, row.bsize, row.dims)]
        return core, [(max(a - int(o), 0), min(b + int(o), int(d))) for (a, b), o, d in zip(core, overlap, row.dims)]

    def send(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if any(int(o) > int(s) for o, s in zip(overlap, row.bsize)):
                    raise ValueError("overlap must not exceed a block")
                own = tuple(int(getattr(row, b)) for b in B.BLK)
                core, wide = reach(own, row)
                labels = np.asarray(row.w, dtype=np.int64).reshape([b - a for a, b in wide])
                grid = [-(-int(d) // int(s)) for d, s in zip(row.dims, row.bsize)]
                for step in np.ndindex(3, 3, 3):
                    other = tuple(o + int(i) - 1 for o, i in zip(own, step))
                    if other == own or not all(0 <= i < n for i, n in zip(other, grid)):
                        continue
                    far_core, far_wide = reach(other, row)
                    first, second = ((core, far_wide), (wide, far_core)) if own < other else ((wide, far_core), (core, far_wide))
                    slabs = []
                    for one, two in (first, second):
                        box = [(max(a, c), min(b, d)) for (a, b), (c, d) in zip(one, two)]
                        slabs.append(labels[tuple(slice(a - w[0], max(a, b) - w[0]) for (a, b), w in zip(box, wide))].ravel())
                    slab = np.concatenate(slabs)
                    if slab.any():
                        out.append([*[getattr(row, k) for k in keys], *min(own, other), *max(own, other), int(own > other), slab])
            yield pd.DataFrame(out, columns=[*keys, *B.BLK, *far, "side", "slab"])

    sent = segmented.select(*keys, *B.BLK, "dims", "bsize", "w").mapInPandas(send, f"{schema}, side int, slab array<bigint>")
    sides = [F.first(F.when(F.col("side") == i, F.col("slab")), ignorenulls=True).alias(c) for i, c in enumerate("ab")]
    pairs = sent.groupBy(*keys, *B.BLK, *far).agg(*sides).where("a is not null and b is not null")

    def count(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                a, b = np.asarray(row.a, dtype=np.int64), np.asarray(row.b, dtype=np.int64)
                sizes = [dict(zip(*(x.tolist() for x in np.unique(v, return_counts=True)))) for v in (a, b)]
                both = (a != 0) & (b != 0)
                met, n = np.unique(np.stack((a[both], b[both])), axis=1, return_counts=True)
                out += [[*row[:-2], p, q, k, sizes[0][p], sizes[1][q]] for p, q, k in zip(*met.tolist(), n.tolist())]
            yield pd.DataFrame(out, columns=[*keys, *B.BLK, *far, "a", "b", "n", "na", "nb"])

    return pairs.mapInPandas(count, f"{schema}, a bigint, b bigint, n bigint, na bigint, nb bigint")


def merge_overlap(segmented: DataFrame, overlap, least: float = 0.5, keys=("ds",)) -> DataFrame:
    """One label per object across blocks, joined where blocks agree on what both of them segmented.

    Two labels of neighbouring blocks are one object if their intersection over union, where both blocks saw the volume, is
    `least` or more; objects that only touch at a block face stay apart.  `segmented`: from `segment` with the same `overlap`
    (over 0 on every axis that is cut into blocks) and `around`.  An object gets the smallest of its labels.
    """
    if not 0 < least <= 1:
        raise ValueError(f"least must be over 0 and at most 1: {least}")
    segmented = cut(segmented)  # the model's output is used twice
    agreed = cut(overlaps(segmented, overlap, keys).where(F.col("n") >= F.lit(float(least)) * (F.col("na") + F.col("nb") - F.col("n"))))
    places = agreed.select(*keys, F.col("a").alias("label"), *B.BLK).unionByName(
        agreed.select(*keys, F.col("b").alias("label"), *[F.col(f"far_{c}").alias(f"blk_{c}") for c in "zyx"])).distinct()
    roots = components(agreed.select(*keys, "a", "b"), keys).where("label <> root")
    changes = places.join(roots, [*keys, "label"]).withColumnRenamed("root", "new")
    return relabel(segmented.drop("w"), changes, keys)


def label_places(labels: DataFrame, keys=("ds",)) -> DataFrame:
    """Voxel count of each label in each block: keys, block id, label, n."""
    rows = labels.select(*keys, *B.BLK, F.explode("v").alias("label")).where("label <> 0")
    return rows.groupBy(*keys, *B.BLK, "label").agg(F.count("*").alias("n"))


def sizes(labels: DataFrame, keys=("ds",)) -> DataFrame:
    return label_places(labels, keys).groupBy(*keys, "label").agg(F.sum("n").alias("n"))


def drop_small(labels: DataFrame, min_size: int, keys=("ds",)) -> DataFrame:
    """Objects of fewer than `min_size` voxels become background."""
    labels = cut(labels)
    places = label_places(labels, keys)
    small = places.groupBy(*keys, "label").agg(F.sum("n").alias("n")).where(F.col("n") < int(min_size))
    changes = places.drop("n").join(small.select(*keys, "label"), [*keys, "label"])
    return relabel(labels, changes.withColumn("new", F.lit(0).cast("bigint")), keys)


def relabel_sequential(labels: DataFrame, keys=("ds",)) -> DataFrame:
    """Number the labels of each dataset 1..n in label order."""
    labels = cut(labels)
    places = label_places(labels, keys).drop("n")
    ranked = rank_in_group(places.select(*keys, "label").distinct(), keys, "label", "new")
    return relabel(labels, places.join(ranked, [*keys, "label"]), keys)


def diameter_factor(diameter: float, model_diameter: float) -> int:
    """Voxels to average per axis so that objects get the model's diameter."""
    return max(1, int(round(diameter / model_diameter)))


def upsample_labels(vox: DataFrame, factor, dims, keys=("ds",)) -> DataFrame:
    """Coarse label voxels -> every full-resolution voxel they stand for."""
    df = vox
    for a, f, d in zip("zyx", factor, dims):
        lo = F.col(a) * int(f)
        df = df.withColumn(a, F.explode(F.sequence(lo, F.least(lo + int(f), F.lit(int(d)).cast("bigint")) - 1)))
    return df
