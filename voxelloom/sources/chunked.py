"""Chunked array containers: N5 and Zarr v2 datasets <-> block tables.

One chunk file is one block.  Readers derive the chunk paths from the attributes and open
them in the tasks; writers store each block from the task that holds it, aside first, and
put whole datasets in place at the end.  Codecs: raw, gzip, zlib.  Absent chunks are blocks
of zeros (`densify` adds them).  Containers of any rank: see `container`.
"""

from __future__ import annotations

import gzip
import json
import posixpath
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.operators import blocks as B
from voxelloom.session import cut
from voxelloom.sources.files import open_fs, qualified, read_file, read_optional, remove_folder, write_file

#: Sample types of both formats.
TYPES = ("uint8", "uint16", "uint32", "uint64", "int8", "int16", "int32", "int64", "float32", "float64")


def _pack(data: bytes, codec: str) -> bytes:
    if codec == "gzip":
        return gzip.compress(data, mtime=0)
    return zlib.compress(data) if codec == "zlib" else data


def _unpack(data: bytes, codec: str) -> bytes:
    if codec == "gzip":
        return gzip.decompress(data)
    return zlib.decompress(data) if codec == "zlib" else data


def encode_n5(block: np.ndarray, codec: str) -> bytes:
    """Header (mode, rank, sizes x first) and big-endian samples, x fastest."""
    head = struct.pack(">HH", 0, block.ndim) + struct.pack(f">{block.ndim}I", *block.shape[::-1])
    return head + _pack(block.astype(block.dtype.newbyteorder(">")).tobytes(), codec)


def decode_n5(data: bytes, dtype: str, codec: str) -> np.ndarray:
    rank = struct.unpack(">H", data[2:4])[0]
    shape = struct.unpack(f">{rank}I", data[4:4 + 4 * rank])[::-1]
    body = _unpack(data[4 + 4 * rank:], codec)
    return np.frombuffer(body, dtype=np.dtype(dtype).newbyteorder(">")).reshape(shape)


def encode_zarr(block: np.ndarray, chunk, codec: str) -> bytes:
    """Little-endian samples of a full chunk; border chunks are padded with zeros."""
    full = np.zeros(chunk, dtype=block.dtype)
    full[tuple(slice(0, n) for n in block.shape)] = block
    return _pack(full.astype(full.dtype.newbyteorder("<")).tobytes(), codec)


def n5_attributes(dims, chunk, dtype, codec, spacing=None) -> dict:
    kind = {"type": "gzip", "useZlib": codec == "zlib", "level": -1} if codec in ("gzip", "zlib") else {"type": "raw"}
    out = {"dimensions": [int(d) for d in dims][::-1], "blockSize": [int(c) for c in chunk][::-1], "dataType": dtype, "compression": kind}
    if spacing is not None:
        out["pixelResolution"] = {"dimensions": [float(s) for s in spacing][::-1], "unit": "um"}
    return out


def zarr_attributes(dims, chunk, dtype, codec) -> dict:
    return {
        "zarr_format": 2, "shape": [int(d) for d in dims], "chunks": [int(c) for c in chunk], "dtype": np.dtype(dtype).newbyteorder("<").str,
        "compressor": {"id": codec, "level": 5} if codec in ("gzip", "zlib") else None, "fill_value": 0, "order": "C", "filters": None,
        "dimension_separator": ".",
    }


def read_attributes(folder: str, fmt: str) -> dict:
    """dims, chunk (slowest axis first), dtype, codec, separator, fill value and spacing (None: not stored) of one dataset."""
    if fmt == "n5":
        a = json.loads(read_file(f"{folder}/attributes.json"))
        c = a.get("compression", {"type": "raw"})
        codec = "zlib" if c.get("useZlib") else c["type"]
        spacing = (a.get("pixelResolution") or {}).get("dimensions")
        return {"dims": a["dimensions"][::-1], "chunk": a["blockSize"][::-1], "dtype": a["dataType"], "codec": codec, "sep": "/", "fill": 0,
                "spacing": spacing[::-1] if spacing else None}
    a = json.loads(read_file(f"{folder}/.zarray"))
    if a.get("filters") or a.get("order", "C") != "C":
        raise ValueError(f"unsupported layout in {folder}")
    codec = (a.get("compressor") or {"id": "raw"})["id"]
    return {"dims": a["shape"], "chunk": a["chunks"], "dtype": a["dtype"], "codec": codec, "sep": a.get("dimension_separator", "."),
            "fill": a.get("fill_value") or 0, "spacing": None}


def chunk_name(at, fmt: str, sep: str = ".") -> str:
    """Path of a chunk below its dataset; `at`: its place, slowest axis first."""
    return "/".join(map(str, at[::-1])) if fmt == "n5" else sep.join(map(str, at))


def decode(content: bytes, fmt: str, dtype: str, codec: str, dims, chunk, at) -> np.ndarray:
    """Samples of a chunk, clipped to the volume, slowest axis first."""
    if fmt == "n5":
        return decode_n5(content, dtype, codec)
    block = np.frombuffer(_unpack(content, codec), dtype=np.dtype(dtype)).reshape([int(c) for c in chunk])
    return block[tuple(slice(0, min(c, d - i * c)) for c, d, i in zip(chunk, dims, at))]


def write(blocks: DataFrame, root: str, folder, fmt: str = "n5", dtype: str = "uint16", codec: str = "gzip", cols=("v",), spacing=None,
          lead=(), unit=None, group=None) -> int:
    """Write a block table; returns the number of chunk files.

    `folder`: column expression with the path of a block's dataset below `root` (say `<container>/<subpath>`), so one job writes
    many datasets.  More than one column makes a vector dataset with the component as the first (slowest) axis; `lead` names columns
    (t and c, say) that are axes before z, y and x, one chunk per value, from 0 to their largest value.

    All chunks go to a hidden folder first; `blocks` is evaluated once, and may read what is replaced.  Only when every chunk is
    there, each `unit` (column with a path that holds the datasets of `folder`; by default the dataset) takes the place of what
    was there before, as a whole.  A writer that fails leaves the old data as it was.  `group(folder, datasets)` gives more files
    of a unit (path below it -> bytes) from the paths and shapes of its datasets.
    """
    if dtype not in TYPES or codec not in ("raw", "gzip", "zlib"):
        raise ValueError(f"unsupported sample type {dtype} or codec {codec}")
    if lead and len(cols) > 1:
        raise ValueError("a dataset is a vector or has leading axes, not both")
    root, vector = qualified(blocks.sparkSession, root).rstrip("/"), len(cols) > 1
    stage, old = (f"{root}/.{name}-{uuid.uuid4().hex}" for name in ("part", "old"))
    unit = folder if unit is None else unit
    df = blocks.select(folder.alias("folder"), unit.alias("unit"), *B.BLK, "dims", "bsize", *[F.col(c).cast("bigint").alias(f"lead{i}") for i, c in enumerate(lead)], *cols)
    first = [f"lead{i}" for i in range(len(lead))]

    def put(batches):
        for pdf in batches:
            made = {}
            for row in pdf.itertuples(index=False):
                shape = B.core_shape(row)
                a = np.stack([np.asarray(getattr(row, c)).reshape(shape) for c in cols]).astype(dtype)
                chunk, at = [int(b) for b in row.bsize], [int(getattr(row, b)) for b in B.BLK]
                if vector:
                    chunk, at = [len(cols), *chunk], [0, *at]
                else:
                    a = a[0].reshape((1,) * len(lead) + a.shape[1:])
                    chunk, at = [1] * len(lead) + chunk, [int(getattr(row, x)) for x in first] + at
                write_file(f"{stage}/{row.folder}/{chunk_name(at, fmt)}", encode_n5(a, codec) if fmt == "n5" else encode_zarr(a, chunk, codec))
                key = (row.folder, row.unit, tuple(map(int, row.dims)), tuple(map(int, row.bsize)))
                n, high = made.get(key, (0, [0] * len(lead)))
                made[key] = n + 1, [max(h, int(getattr(row, x)) + 1) for h, x in zip(high, first)]
            yield pd.DataFrame([[*k, n, high] for k, (n, high) in made.items()], columns=["folder", "unit", "dims", "bsize", "n", "high"])

    shape = "folder string, unit string, dims array<bigint>, bsize array<bigint>, n bigint, high array<bigint>"
    high = [F.max(F.col("high")[i]) for i in range(len(lead))]
    try:
        heads = df.mapInPandas(put, shape).groupBy("folder", "unit", "dims", "bsize").agg(F.sum("n").alias("n"), F.array(*high).cast("array<bigint>").alias("high"))
        heads = cut(heads)
        if heads.groupBy("folder").count().where("count > 1").head(1):
            raise ValueError("blocks of one dataset differ in its shape")

        def swap(pdf):
            name, sizes = pdf["unit"].iloc[0], {}
            for row in pdf.itertuples(index=False):
                dims, chunk = [*row.high, *row.dims], [1] * len(lead) + [*row.bsize]
                if vector:
                    dims, chunk = [len(cols), *dims], [len(cols), *chunk]
                sizes[row.folder] = [int(d) for d in dims]
                if fmt == "n5":
                    write_file(f"{stage}/{row.folder}/attributes.json", json.dumps(n5_attributes(dims, chunk, dtype, codec, spacing)).encode())
                else:
                    write_file(f"{stage}/{row.folder}/.zarray", json.dumps(zarr_attributes(dims, chunk, dtype, codec)).encode())
            for path, content in (group(name, sizes) if group else {}).items():
                write_file(f"{stage}/{name}/{path}", content)
            replace_folder(f"{stage}/{name}", f"{root}/{name}", f"{old}/{name}")
            return pd.DataFrame({"n": [int(pdf["n"].sum())]})

        done = heads.groupBy("unit").applyInPandas(swap, "n bigint").agg(F.sum("n")).first()[0]
    finally:
        remove_folder(stage)
    remove_folder(old)
    return int(done or 0)


def replace_folder(new: str, place: str, aside: str) -> None:
    """Move `new` to `place`, and what was there before to `aside`; a second call changes nothing."""
    fs, source = open_fs(new)
    target, kept = open_fs(place)[1], open_fs(aside)[1]
    if fs.get_file_info(source).type == pafs.FileType.NotFound:
        return  # an earlier attempt of the task moved it
    if fs.get_file_info(target).type != pafs.FileType.NotFound:
        fs.create_dir(posixpath.dirname(kept), recursive=True)
        fs.move(target, kept)
    fs.create_dir(posixpath.dirname(target), recursive=True)
    fs.move(source, target)


def datasets(root: str, fmt: str = "n5", subpath: str | None = None) -> list[str]:
    """Datasets below `root` (relative paths), by walking down to the first folder that is one; chunks are never listed.

    Hidden folders are passed over: a writer may be filling them.
    """
    fs, base = open_fs(root)
    mark, found, todo = "attributes.json" if fmt == "n5" else ".zarray", [], [base.rstrip("/")]
    while todo:
        folder = todo.pop()
        here = fs.get_file_info(f"{folder}/{mark}").type == pafs.FileType.File
        if here and (fmt != "n5" or "dimensions" in json.loads(fs.open_input_file(f"{folder}/{mark}").read())):
            found.append(folder[len(base.rstrip("/")):].strip("/"))
        else:
            entries = fs.get_file_info(pafs.FileSelector(folder))
            todo += [e.path for e in entries if e.type == pafs.FileType.Directory and not e.base_name.startswith(".")]
    tail = "/" + subpath.strip("/") if subpath else ""
    return sorted(f for f in found if not tail or ("/" + f).endswith(tail))


def read(spark: SparkSession, root: str, fmt: str = "n5", subpath: str | None = None, cols=("v",)) -> DataFrame:
    """All datasets below `root` (or those whose path ends in `subpath`) as blocks: folder, blk_z, blk_y, blk_x, dims, bsize, <cols>.

    Chunk paths follow from the attributes and are opened by the tasks, so only chunks of these datasets are touched;
    chunks that do not exist are left out (see `densify`).
    """
    root, vector = qualified(spark, root).rstrip("/"), len(cols) > 1
    rows = []
    for name in datasets(root, fmt, subpath):
        a = read_attributes(f"{root}/{name}".rstrip("/"), fmt)
        if len(a["dims"]) != 3 + vector:
            raise ValueError(f"{name} has {len(a['dims'])} axes, not {3 + vector}")
        grid = [-(-d // c) for d, c in zip(a["dims"], a["chunk"])][-3:]
        rows.append((name, [int(d) for d in a["dims"]], [int(c) for c in a["chunk"]], grid, a["dtype"], a["codec"], a["sep"]))
    known = spark.createDataFrame(rows, "folder string, full array<bigint>, chunk array<bigint>, grid array<bigint>, dtype string, codec string, sep string")
    count = F.col("grid")[0] * F.col("grid")[1] * F.col("grid")[2]
    chunks = known.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1))).repartition("folder", "at")

    def load(batches):
        for pdf in B.pieces(batches, lambda r: 8 * int(np.prod(r.chunk))):
            out = []
            for r in pdf.itertuples(index=False):
                at = [int(i) for i in np.unravel_index(r.at, [int(g) for g in r.grid])]
                place = [0] * vector + at
                content = read_optional(f"{root}/{r.folder}/{chunk_name(place, fmt, r.sep)}")
                if content is None:
                    continue
                block = decode(content, fmt, r.dtype, r.codec, r.full, r.chunk, place)
                parts = [block] if not vector else list(block)
                out.append([r.folder, *at, r.full[-3:], r.chunk[-3:], *[p.astype(float).ravel() for p in parts]])
            yield pd.DataFrame(out, columns=["folder", *B.BLK, "dims", "bsize", *cols])

    schema = "folder string, blk_z bigint, blk_y bigint, blk_x bigint, dims array<bigint>, bsize array<bigint>"
    return chunks.mapInPandas(load, schema + "".join(f", {c} array<double>" for c in cols))


def densify(blocks: DataFrame, keys=("folder",), cols=("v",), fill: float = 0.0) -> DataFrame:
    """Add the blocks that have no chunk file."""
    base = blocks.select(*keys, "dims", "bsize").distinct()
    for i, b in enumerate(B.BLK):
        base = base.withColumn(b, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("dims")[i] - 1) / F.col("bsize")[i]))))
    size = F.lit(1).cast("bigint")
    for i, b in enumerate(B.BLK):
        size = size * F.least(F.col("bsize")[i], F.col("dims")[i] - F.col(b) * F.col("bsize")[i])
    got = base.join(blocks.select(*keys, *B.BLK, *cols), [*keys, *B.BLK], "left")
    return got.withColumns({c: F.coalesce(c, F.array_repeat(F.lit(float(fill)), size.cast("int"))) for c in cols})
