"""Containers of any rank as a Spark data source, and whole image pyramids as containers.

`spark.read.format("chunked").option("format", "zarr").load(root)` has one row a block of each time and channel:

    folder, t, c, blk_z, blk_y, blk_x, dims, bsize, v array<double>

Axes a dataset lacks are null.  Filters on folder (equal, in, starts, ends), t, c and block ids (equal, in, compared) go to the
source: datasets that cannot match are left out, and chunks that cannot match are not opened.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as DS
from pyspark.sql import functions as F

from voxelloom.operators import blocks as B
from voxelloom.operators.pyramid import halve, level_dims
from voxelloom.session import cut
from voxelloom.sources import chunked as C
from voxelloom.sources.files import qualified, read_optional

SCHEMA = ("folder string, t bigint, c bigint, blk_z bigint, blk_y bigint, blk_x bigint, dims array<bigint>, bsize array<bigint>, v array<double>")
KIND = pa.schema([("folder", pa.string()), *[(n, pa.int64()) for n in ("t", "c", *B.BLK)], ("dims", pa.list_(pa.int64())), ("bsize", pa.list_(pa.int64())),
                  ("v", pa.list_(pa.float64()))])
#: The axis of each filtered column, slowest first.
AXIS = {"t": "t", "c": "c", "blk_z": "z", "blk_y": "y", "blk_x": "x"}
#: Bytes of samples of a partition, about.
RUN_BYTES = 64 << 20
#: Bytes of samples that are worth a task of their own.
LEAST_BYTES = 1 << 20
#: Rows of a batch at most; its blocks make B.PIECE_BYTES at most, or one block.
BATCH_ROWS = 1000

#: How each pushed filter holds for a value that is not null.
TESTS = {
    DS.EqualTo: lambda x, v: x == v, DS.In: lambda x, v: x in v, DS.GreaterThan: lambda x, v: x > v, DS.GreaterThanOrEqual: lambda x, v: x >= v,
    DS.LessThan: lambda x, v: x < v, DS.LessThanOrEqual: lambda x, v: x <= v, DS.StringStartsWith: lambda x, v: x.startswith(v),
    DS.StringEndsWith: lambda x, v: x.endswith(v), DS.IsNotNull: lambda x, v: True,
}


def holds(tests: list[tuple[type, object]], value) -> bool:
    """Whether a value passes all pushed filters of its column; null passes none."""
    return not tests or value is not None and all(TESTS[kind](value, wanted) for kind, wanted in tests)


@dataclass
class Chunks:
    """A run of chunks of one dataset: `first` to `last` of the product of `places`, the chunk numbers of each axis."""

    folder: str
    about: dict
    axes: str
    places: list[list[int]]
    first: int
    last: int


@dataclass
class Runs(DS.InputPartition):
    """What a task reads: runs of any number of datasets."""

    runs: list[Chunks]

    def __post_init__(self):
        super().__init__(None)


def dealt(runs: list[Chunks], tasks: int) -> list[Runs]:
    """Runs of whole datasets dealt to partitions of about equal bytes, in their order; long ones are cut.

    At least `tasks` partitions, if they are worth it, of at most RUN_BYTES each.
    """
    sizes = [math.prod(r.about["chunk"]) * 8 for r in runs]
    total = sum((r.last - r.first) * n for r, n in zip(runs, sizes))
    limit = min(RUN_BYTES, max(LEAST_BYTES, -(-total // max(tasks, 1))))
    out, held, filled = [], [], 0
    for run, size in zip(runs, sizes):
        at = run.first
        while at < run.last:
            if held and filled + size > limit:
                out.append(Runs(held))
                held, filled = [], 0
            to = min(run.last, at + max(1, (limit - filled) // size))
            held.append(replace(run, first=at, last=to))
            filled += (to - at) * size
            at = to
    return [*out, Runs(held)]


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in KIND], schema=KIND)


@dataclass
class Reader(DS.DataSourceReader):
    root: str
    fmt: str
    axes: str
    subpath: str | None
    tasks: int = 1
    tests: dict[str, list[tuple[type, object]]] = field(default_factory=dict)

    def pushFilters(self, filters: list[DS.Filter]) -> Iterator[DS.Filter]:
        for f in filters:
            name, kind = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None, type(f)
            text = kind in (DS.StringStartsWith, DS.StringEndsWith)
            if kind in TESTS and (name in AXIS and not text or name == "folder" and kind in (DS.EqualTo, DS.In, DS.IsNotNull) or name == "folder" and text):
                self.tests.setdefault(name, []).append((kind, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> Sequence[Runs]:
        out = []
        for folder in C.datasets(self.root, self.fmt, self.subpath):
            if not holds(self.tests.get("folder", []), folder):
                continue
            about = C.read_attributes(f"{self.root}/{folder}".rstrip("/"), self.fmt)
            rank = len(about["dims"])
            if not 3 <= rank <= len(self.axes):
                raise ValueError(f"{folder} has {rank} axes, not 3 to {len(self.axes)}")
            axes, places = self.axes[-rank:], []
            if any(self.tests.get(name) and axis not in axes for name, axis in AXIS.items()):
                continue  # a filter on an axis that is not there: null
            for axis, size, step in zip(axes, about["dims"], about["chunk"]):
                name = next(n for n, a in AXIS.items() if a == axis)
                wanted = self.tests.get(name, [])
                grid = range(-(-size // step))
                places.append([i for i in grid if any(holds(wanted, j) for j in (range(i * step, min(size, i * step + step)) if axis in "tc" else (i,)))])
            out.append(Chunks(folder, about, axes, places, 0, math.prod(map(len, places))))
        return dealt(out, self.tasks)

    def read(self, partition: Runs) -> Iterator[pa.RecordBatch]:
        rows, total = [], 0
        for run in partition.runs:
            for row in self.blocks(run):
                rows.append(row)
                total += row["v"].nbytes
                if total >= B.PIECE_BYTES or len(rows) >= BATCH_ROWS:
                    yield batch_of(rows)
                    rows, total = [], 0
        if rows:
            yield batch_of(rows)

    def blocks(self, p: Chunks) -> Iterator[dict]:
        about = p.about
        for flat in range(p.first, p.last):
            at = [places[i] for places, i in zip(p.places, np.unravel_index(flat, [len(x) for x in p.places]))]
            content = read_optional("/".join([f"{self.root}/{p.folder}".rstrip("/"), C.chunk_name(at, self.fmt, about["sep"])]))
            if content is None:
                continue
            block = C.decode(content, self.fmt, about["dtype"], about["codec"], about["dims"], about["chunk"], at)
            lead = p.axes[:-3]
            for inner in itertools.product(*[range(n) for n in block.shape[:-3]]):
                row = dict.fromkeys(("t", "c")) | {a: i * about["chunk"][k] + j for k, (a, i, j) in enumerate(zip(lead, at, inner))}
                if all(holds(self.tests.get(a, []), row[a]) for a in ("t", "c")):
                    yield {"folder": p.folder, **row, **dict(zip(B.BLK, at[-3:])), "dims": about["dims"][-3:], "bsize": about["chunk"][-3:],
                           "v": block[inner].astype(float).ravel()}


class ChunkedSource(DS.DataSource):
    """Options: path, format (n5 or zarr), subpath (end of the paths read), axes (`tczyx`: the last ones are those of the data), tasks
    (so many partitions at least, if there is enough to read)."""

    @classmethod
    def name(cls) -> str:
        return "chunked"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DS.DataSourceReader:
        axes = self.options.get("axes", "tczyx")
        if axes[-3:] != "zyx" or not set(axes) <= set("tczyx"):
            raise ValueError(f"axes must end in zyx, after t and c in their order: {axes}")
        return Reader(self.options["path"].rstrip("/"), self.options.get("format", "n5"), axes, self.options.get("subpath"),
                      int(self.options.get("tasks", 1)))


def read(spark: SparkSession, root: str, fmt: str = "n5", subpath: str | None = None, axes: str = "tczyx") -> DataFrame:
    """All datasets below `root` as blocks (see the module); missing chunks have no row."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkedSource)
    found = spark.read.format("chunked").option("format", fmt).option("axes", axes).option("tasks", 4 * spark.sparkContext.defaultParallelism)
    return (found if subpath is None else found.option("subpath", subpath)).load(qualified(spark, root))


def half(blocks: DataFrame, keys) -> DataFrame:
    """The next level of a block table, in blocks of the same size: each block is halved where it lies, eight meet in one shuffle."""
    keep = [*keys, *B.BLK, "dims", "bsize"]
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.select(*keep).schema)

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if any(int(s) % 2 for s in row.bsize):
                    raise ValueError(f"block sides must be even: {list(row.bsize)}")
                org, core = B.core_origin(row), B.core_shape(row)
                a = halve(np.asarray(row.v, dtype=float).reshape(core))
                out.append([*[getattr(row, k) for k in keys], *[int(getattr(row, b)) // 2 for b in B.BLK], level_dims(row.dims), row.bsize,
                            [*[o // 2 for o in org], *a.shape], a.ravel()])
            yield pd.DataFrame(out, columns=[*keep, "part_box", "part_v"])

    parts = blocks.select(*keep, "v").mapInPandas(run, f"{head}, part_box array<bigint>, part_v array<double>")
    met = parts.groupBy(*keys, *B.BLK).agg(F.first("dims").alias("dims"), F.first("bsize").alias("bsize"), F.collect_list(F.struct("part_box", "part_v")).alias("p"))
    met = met.select(*keep, F.flatten("p.part_box").alias("part_box"), F.flatten("p.part_v").alias("part_v"))
    return B.map_blocks(met, lambda arrays, row: arrays, keys=keys)


def metadata(levels: int, fmt: str, spacing, lead: Sequence[str]):
    """More files of a pyramid's folder: its levels, their factors and voxel sizes."""
    axes = [*lead, "z", "y", "x"]

    def files(folder: str, sizes: dict[str, list[int]]) -> dict[str, bytes]:
        steps = [2 ** s for s in range(levels + 1)]
        if fmt == "n5":
            about = {"scales": [[f] * 3 for f in steps], "axes": axes[::-1], "units": ["um"] * 3, "pixelResolution": {"dimensions": [float(s) for s in spacing][::-1], "unit": "um"},
                     "multiscales": [{"datasets": [{"path": f"s{i}", "transform": {"axes": ["z", "y", "x"], "scale": [float(s * f) for s in spacing],
                                                                                   "translate": [float(s * (f - 1) / 2) for s in spacing]}} for i, f in enumerate(steps)]}]}
            return {"attributes.json": json.dumps(about).encode()}
        kinds = {"t": "time", "c": "channel"}
        scale = [{"path": f"s{i}", "coordinateTransformations": [
            {"type": "scale", "scale": [1.0] * len(lead) + [float(s * f) for s in spacing]},
            {"type": "translation", "translation": [0.0] * len(lead) + [float(s * (f - 1) / 2) for s in spacing]}]} for i, f in enumerate(steps)]
        about = {"multiscales": [{"version": "0.4", "name": folder, "axes": [{"name": a, "type": kinds.get(a, "space"), **({} if a in kinds else {"unit": "micrometer"})}
                                                                              for a in axes], "datasets": scale}]}
        return {".zgroup": b'{"zarr_format": 2}', ".zattrs": json.dumps(about).encode()}

    return files


def write_pyramid(blocks: DataFrame, root: str, folder, levels: int, fmt: str = "zarr", dtype: str = "uint16", codec: str = "gzip",
                  spacing=(1.0, 1.0, 1.0), keys=("ds",), lead=()) -> int:
    """Write a block table and `levels` coarser ones as s0, s1, ... of one container folder; returns the number of chunk files.

    Every level has blocks of the same (even) size and is the mean of the level above; border voxels of an odd axis average the
    voxels that exist.  Voxels never leave their block as rows: a block is halved where it lies, so a level moves an eighth of
    the level above.  `keys` name a dataset; those also named by `lead` (t, c) are axes of it.  The folder gets the metadata of
    its levels and takes the place of an older one as a whole, when all levels are there.
    """
    if levels < 0:
        raise ValueError("levels must be 0 or more")
    now, everything = blocks.select(*keys, *B.BLK, "dims", "bsize", "v"), None
    for s in range(levels + 1):
        if s:
            now = half(now, keys)
        now = cut(now)  # read twice: for the container and for the next level
        level = now.withColumn("scale", F.lit(s))
        everything = level if everything is None else everything.unionByName(level)
    return C.write(everything, root, F.concat(folder, F.lit("/s"), "scale"), fmt, dtype, codec, ("v",), None, lead, folder, metadata(levels, fmt, spacing, lead))
