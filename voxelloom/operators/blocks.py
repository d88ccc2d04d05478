"""Block tables: the stored form of a volume, and the halo exchange between blocks.

A *voxel view* has one row per voxel: key columns, z, y, x and value columns.
A *block table* has one row per block:

    <keys>, blk_z, blk_y, blk_x, dims array<bigint>, bsize array<bigint>, <cols> array<...>

with the values in z-major order.  Blocks at the upper volume border are clipped
to the volume.  Every neighbourhood operator works on block tables: one shuffle
brings a block's core and the border slabs that it lacks together, and a small array
kernel then runs on each block with its halo.  A group never holds more than one block plus its halo.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
BLK = ("blk_z", "blk_y", "blk_x")


def _lit_array(values) -> Column:
    return F.array(*[F.lit(int(v)).cast("bigint") for v in values])


#: Bytes of block values that a kernel makes before it hands them on.
PIECE_BYTES = 8 << 20


def pieces(batches, size):
    """Batches cut where their rows would make more than PIECE_BYTES; `size(row)` is what a row makes.

    Arrow bounds a batch by what comes in: small rows (an empty block, a chunk's path) become whole blocks.
    """
    for pdf in batches:
        first = total = 0
        for i, row in enumerate(pdf.itertuples(index=False)):
            n = size(row)
            if total and total + n > PIECE_BYTES:
                yield pdf.iloc[first:i]
                first, total = i, 0
            total += n
        yield pdf.iloc[first:]


def _held(column) -> int:
    """Bytes of a column's values, about."""
    if isinstance(column, np.ndarray) and column.dtype != object:
        return column.nbytes
    return sum(getattr(x, "nbytes", 64) for x in column)


def _joined(columns: list):
    """Columns one below the other; a list where values are no numbers."""
    if all(isinstance(c, np.ndarray) and c.dtype != object for c in columns):
        return np.concatenate(columns)
    return [x for c in columns for x in c]


def together(made, names, keys=()):
    """Frames of about PIECE_BYTES from (key values, {name: column}) of single blocks; handing on each one alone costs far more."""
    held, total = [], 0

    def frame():
        counts = [len(columns[names[0]]) for _, columns in held]
        out = {k: np.repeat(pd.Series([key[i] for key, _ in held]), counts).reset_index(drop=True) for i, k in enumerate(keys)}
        return pd.DataFrame({**out, **{n: _joined([columns[n] for _, columns in held]) for n in names}})

    for key, columns in made:
        if not len(columns[names[0]]):
            continue
        held.append((key, columns))
        total += sum(_held(columns[n]) for n in names)
        if total >= PIECE_BYTES:
            yield frame()
            held, total = [], 0
    if held:
        yield frame()


def block_bytes(cols: int = 1):
    """The size of `cols` arrays of a block row, for `pieces`."""
    return lambda row: 8 * cols * int(np.prod(row.bsize))


def never_broadcast(side: DataFrame) -> DataFrame:
    """A join side of whole blocks: the join shuffles and merges.

    Spark takes an array for one element, and a row that explodes for one row.  By that estimate large block tables look
    small, and a join would collect them in the driver.
    """
    return side.hint("merge")


def with_block_id(vox: DataFrame, bsize) -> DataFrame:
    """Add blk_z, blk_y, blk_x = floor(coordinate / block size)."""
    return vox.withColumns(
        {b: F.floor(F.col(a) / F.lit(int(n))).cast("bigint") for a, b, n in zip(AXES, BLK, bsize)}
    )


def block_skeleton(ids: DataFrame, dims, bsize, keys=("ds",)) -> DataFrame:
    """One row per (key, block) of a volume of shape `dims`."""
    out = ids.select(*keys).distinct()
    for b, d, n in zip(BLK, dims, bsize):
        out = out.withColumn(b, F.explode(F.sequence(F.lit(0), F.lit((int(d) - 1) // int(n)))))
        out = out.withColumn(b, F.col(b).cast("bigint"))
    return out


def pack(vox, dims, bsize, keys=("ds",), cols=("v",), dtype="double", fill=0, ids=None) -> DataFrame:
    """Voxel rows -> dense blocks.  Absent voxels, and blocks without any, get `fill`.

    Only the voxels that exist are shuffled; the empty ones appear inside the task
    that builds the block.  `ids` lists the datasets (default: those in `vox`).
    """
    shape = [F.least(F.lit(int(n)), F.lit(int(d)) - F.col(b) * int(n)) for b, d, n in zip(BLK, dims, bsize)]
    local = [F.col(a) - F.col(b) * int(n) for a, b, n in zip(AXES, BLK, bsize)]
    off = ((local[0] * shape[1] + local[1]) * shape[2] + local[2]).cast("bigint")
    entry = F.struct(off.alias("off"), *[F.col(c).cast(dtype).alias(c) for c in cols])
    sparse = with_block_id(vox, bsize).groupBy(*keys, *BLK).agg(F.collect_list(entry).alias("e"))
    base = block_skeleton(vox if ids is None else ids, dims, bsize, keys)
    df = base.join(never_broadcast(sparse), [*keys, *BLK], "left").select(
        *keys, *BLK, _lit_array(dims).alias("dims"), _lit_array(bsize).alias("bsize"),
        F.coalesce("e.off", F.array().cast("array<bigint>")).alias("off"),
        *[F.coalesce(f"e.{c}", F.array().cast(f"array<{dtype}>")).alias(c) for c in cols],
    )
    np_type = np.int64 if dtype == "bigint" else np.float64

    def fill_blocks(batches):
        for pdf in pieces(batches, block_bytes(len(cols))):
            dense = {c: [] for c in cols}
            for row in pdf.itertuples(index=False):
                _, core = _core(row)
                for c in cols:
                    a = np.full(int(np.prod(core)), fill, dtype=np_type)
                    a[np.asarray(row.off, dtype=np.int64)] = getattr(row, c)
                    dense[c].append(a)
            yield pdf.drop(columns=["off"]).assign(**dense)

    return df.mapInPandas(fill_blocks, df.drop("off").schema)


def unpack(blocks: DataFrame, cols=("v",), keys=("ds",), extra=()) -> DataFrame:
    """Blocks -> voxel rows (JVM side, no shuffle)."""
    ny = F.least(F.col("bsize")[1], F.col("dims")[1] - F.col("blk_y") * F.col("bsize")[1])
    nx = F.least(F.col("bsize")[2], F.col("dims")[2] - F.col("blk_x") * F.col("bsize")[2])
    src = F.col(cols[0]) if len(cols) == 1 else F.arrays_zip(*cols)
    df = blocks.select(
        *keys, *BLK, "bsize", *extra, ny.alias("_ny"), nx.alias("_nx"), F.posexplode(src).alias("_p", "_v")
    )
    vals = [F.col("_v").alias(cols[0])] if len(cols) == 1 else [F.col(f"_v.{c}").alias(c) for c in cols]
    return df.select(
        *keys, *extra,
        (F.col("blk_z") * F.col("bsize")[0] + F.expr("_p div (_ny * _nx)")).alias("z"),
        (F.col("blk_y") * F.col("bsize")[1] + F.expr("(_p div _nx) % _ny")).alias("y"),
        (F.col("blk_x") * F.col("bsize")[2] + F.expr("_p % _nx")).alias("x"),
        *vals,
    )


def exchange(blocks: DataFrame, halo=(0, 0, 0), cols=("v",), keys=("ds",), bsize=None) -> DataFrame:
    """Give every block the slabs it needs from its neighbours.

    Each source block is cut (with `slice`, JVM side) into the boxes its target
    blocks want; one shuffle groups the boxes by target.  With `bsize` the target
    grid has another block size, which makes this the rechunk operator as well.
    Output: keys, block id, dims, bsize, part_box (6 numbers per part), part_<col>.
    """
    target = [F.col("bsize")[i] for i in range(3)] if bsize is None else [F.lit(int(b)).cast("bigint") for b in bsize]
    df = blocks
    for i, b in enumerate(BLK):
        h = int(halo[i])
        lo = F.col(b) * F.col("bsize")[i]
        hi = F.least(lo + F.col("bsize")[i], F.col("dims")[i])
        last = F.floor((F.col("dims")[i] - 1) / target[i])
        df = df.withColumns({f"_a{i}": lo, f"_b{i}": hi})
        df = df.withColumn(
            f"_t{i}",
            F.explode(
                F.sequence(
                    F.greatest(F.floor((lo - h) / target[i]), F.lit(0).cast("bigint")),
                    F.least(F.floor((hi - 1 + h) / target[i]), last),
                )
            ),
        )
    boxes = {}
    for i in range(3):
        h = int(halo[i])
        t = F.col(f"_t{i}") * target[i]
        boxes[f"_lo{i}"] = F.greatest(t - h, F.col(f"_a{i}"))
        boxes[f"_hi{i}"] = F.least(t + target[i] + h, F.col(f"_b{i}"))
    df = df.withColumns(boxes)
    box = F.array(*[F.col(f"_lo{i}") for i in range(3)], *[F.col(f"_hi{i}") - F.col(f"_lo{i}") for i in range(3)])
    part = F.struct(box.alias("box"), *[slab(c).alias(c) for c in cols])
    new_size = F.col("bsize") if bsize is None else _lit_array(bsize)
    df = df.select(
        *keys, *[F.col(f"_t{i}").alias(b) for i, b in enumerate(BLK)], "dims", new_size.alias("bsize"), part.alias("p")
    )
    df = df.groupBy(*keys, *BLK).agg(
        F.first("dims").alias("dims"), F.first("bsize").alias("bsize"), F.collect_list("p").alias("p")
    )
    return df.select(
        *keys, *BLK, "dims", "bsize", F.flatten("p.box").alias("part_box"),
        *[F.flatten(f"p.{c}").alias(f"part_{c}") for c in cols],
    )


def slab(col: str) -> Column:
    """Values of the box [_lo, _hi) out of a block that spans [_a, _b)."""
    a, b = [F.col(f"_a{i}") for i in range(3)], [F.col(f"_b{i}") for i in range(3)]
    lo, hi = [F.col(f"_lo{i}") for i in range(3)], [F.col(f"_hi{i}") for i in range(3)]
    ny, nx = b[1] - a[1], b[2] - a[2]
    rel = [lo[i] - a[i] for i in range(3)]
    n = [hi[i] - lo[i] for i in range(3)]
    whole_rows = (n[2] == nx) & (n[1] == ny)
    contiguous = F.slice(F.col(col), (rel[0] * ny * nx + 1).cast("int"), (n[0] * ny * nx).cast("int"))
    pieces = F.flatten(
        F.transform(
            F.sequence(rel[0], rel[0] + n[0] - 1),
            lambda z: F.flatten(
                F.transform(
                    F.sequence(rel[1], rel[1] + n[1] - 1),
                    lambda y: F.slice(F.col(col), ((z * ny + y) * nx + rel[2] + 1).cast("int"), n[2].cast("int")),
                )
            ),
        )
    )
    return F.when(whole_rows, contiguous).otherwise(pieces)


def _core(row):
    """Origin and clipped shape of a block row."""
    org = [int(getattr(row, b)) * int(s) for b, s in zip(BLK, row.bsize)]
    core = [min(int(s), int(d) - o) for s, d, o in zip(row.bsize, row.dims, org)]
    return org, core


def assemble(row, col, halo, pad="edge", fill=0):
    """Array of a block with its halo from the parts of an `exchange` row.

    Beyond the volume border the halo repeats the border voxel (`edge`) or holds
    `fill` (`constant`).
    """
    org, core = _core(row)
    lo = [max(o - h, 0) for o, h in zip(org, halo)]
    hi = [min(o + c + h, int(d)) for o, c, h, d in zip(org, core, halo, row.dims)]
    data = np.asarray(getattr(row, f"part_{col}"))
    out = np.full([b - a for a, b in zip(lo, hi)], fill, dtype=data.dtype if data.size else np.float64)
    at = 0
    for box in np.asarray(row.part_box).reshape(-1, 6):
        s, n = box[:3] - lo, box[3:]
        size = int(np.prod(n))
        out[s[0]:s[0] + n[0], s[1]:s[1] + n[1], s[2]:s[2] + n[2]] = data[at:at + size].reshape(n)
        at += size
    width = [(h - (o - a), h - (b - o - c)) for h, o, a, b, c in zip(halo, org, lo, hi, core)]
    if pad == "edge":
        return np.pad(out, width, mode="edge")
    return np.pad(out, width, mode="constant", constant_values=fill)


def map_blocks(halo_df, kernel, halo=(0, 0, 0), cols=("v",), out=(("v", "double"),), keys=("ds",),
               pad="edge", fill=0) -> DataFrame:
    """Run `kernel(arrays, row) -> arrays` on each block; the result is a block table."""
    names = [n for n, _ in out]
    fields = ", ".join(f"{n} array<{t}>" for n, t in out)
    keep = [*keys, *BLK, "dims", "bsize"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in halo_df.select(*keep).schema) + ", " + fields

    def run(batches):
        for pdf in batches:
            made = {n: [] for n in names}
            for row in pdf.itertuples(index=False):
                arrays = [assemble(row, c, halo, pad, fill) for c in cols]
                for n, a in zip(names, kernel(arrays, row)):
                    made[n].append(np.ascontiguousarray(a).ravel())
            yield pdf[keep].assign(**made)

    return halo_df.mapInPandas(run, schema)


def map_block_rows(halo_df, kernel, schema, halo=(0, 0, 0), cols=("v",), keys=("ds",), pad="edge", fill=0):
    """Run `kernel(arrays, row) -> dict of columns` on each block; keys are prefixed."""
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in halo_df.select(*keys).schema)
    names = [s.strip().split(" ")[0] for s in schema.split(",")]

    def made(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield [getattr(row, k) for k in keys], kernel([assemble(row, c, halo, pad, fill) for c in cols], row)

    def run(batches):
        return together(made(batches), names, keys)

    return halo_df.mapInPandas(run, f"{key_schema}, {schema}")


def rechunk(blocks, bsize, cols=("v",), keys=("ds",), dtype="double") -> DataFrame:
    """Re-cut a block table to another block size; one shuffle, no voxel rows."""
    parts = exchange(blocks, (0, 0, 0), cols, keys, bsize)
    return map_blocks(parts, lambda arrays, row: arrays, cols=cols, out=[(c, dtype) for c in cols], keys=keys)


def core_origin(row):
    """Origin of a block, for kernels that need global coordinates."""
    return _core(row)[0]


def core_shape(row):
    return _core(row)[1]


def volume_checks(blocks: DataFrame, col="v", keys=("ds",)) -> DataFrame:
    """Per-block row count and sum, computed on the arrays."""
    return blocks.select(
        *keys, *BLK, F.size(col).cast("bigint").alias("n"),
        F.aggregate(col, F.lit(0.0), lambda s, v: s + v).alias("total"),
    )
