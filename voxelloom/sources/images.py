"""Image files: multi-page TIFF stacks and NRRD volumes.

TIFF files are opened by range: a first pass reads page headers, a second one decodes
pages in parallel, so one huge file is no single task.  Uncompressed and deflate pages.
"""

from __future__ import annotations

import gzip
import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.functions import paths as L
from voxelloom.operators import blocks as B
from voxelloom.sources.files import read_range

#: TIFF tag numbers.
WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, STRIP_AT, STRIP_BYTES, SAMPLE_FORMAT = 256, 257, 258, 259, 270, 273, 279, 339
SAMPLES, PREDICTOR, TILE_WIDTH = 277, 317, 322


def encode_tiff(pages: list[np.ndarray], deflate: bool = False, description: str = "") -> bytes:
    """Little-endian TIFF with one strip per page."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4  # where the offset of the next directory goes
    for i, page in enumerate(pages):
        data = page.astype(page.dtype.newbyteorder("<")).tobytes()
        data = zlib.compress(data) if deflate else data
        strip = len(out)
        out += data + b"\0" * (len(data) % 2)
        text = description.encode() + b"\0" if i == 0 and description else b""
        text_at = len(out)
        out += text + b"\0" * (len(text) % 2)
        fmt = 3 if page.dtype.kind == "f" else (2 if page.dtype.kind == "i" else 1)
        tags = [(WIDTH, 4, 1, page.shape[1]), (HEIGHT, 4, 1, page.shape[0]), (BITS, 3, 1, page.dtype.itemsize * 8),
                (COMPRESSION, 3, 1, 8 if deflate else 1), (STRIP_AT, 4, 1, strip), (STRIP_BYTES, 4, 1, len(data)), (SAMPLE_FORMAT, 3, 1, fmt)]
        if text:
            tags.append((DESCRIPTION, 2, len(text), text_at))
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags))
        for tag in sorted(tags):
            out += struct.pack("<HHII", *tag)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def tiff_pages(path: str) -> tuple[list[dict], str]:
    """Headers of all pages and the description of the first."""
    head = read_range(path, 0, 8)
    order = {b"II": "<", b"MM": ">"}[head[:2]]
    if struct.unpack(order + "H", head[2:4])[0] != 42:
        raise ValueError(f"{path} is no classic TIFF")
    at, pages, text = struct.unpack(order + "I", head[4:8])[0], [], ""
    sizes = {1: 1, 2: 1, 3: 2, 4: 4}
    while at:
        n = struct.unpack(order + "H", read_range(path, at, 2))[0]
        raw = read_range(path, at + 2, 12 * n + 4)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack(order + "HHI", raw[12 * i:12 * i + 8])
            if kind not in sizes:
                continue
            value = raw[12 * i + 8:12 * i + 12]
            if sizes[kind] * count > 4:
                value = read_range(path, struct.unpack(order + "I", value)[0], sizes[kind] * count)
            if kind == 2:
                tags[tag] = value[:count].rstrip(b"\0").decode("utf-8", "replace")
            else:
                code = {1: "B", 3: "H", 4: "I"}[kind]
                tags[tag] = struct.unpack(f"{order}{count}{code}", value[:sizes[kind] * count])
        if not pages:
            text = tags.get(DESCRIPTION, "")
        for tag, name in ((SAMPLES, "more than one sample a pixel"), (PREDICTOR, "a predictor")):
            if tags.get(tag, (1,))[0] != 1:
                raise ValueError(f"{path}: pages with {name} are not supported")
        if TILE_WIDTH in tags or STRIP_AT not in tags:
            raise ValueError(f"{path}: tiled pages are not supported")
        kind = {1: "u", 2: "i", 3: "f"}[tags.get(SAMPLE_FORMAT, (1,))[0]]
        pages.append({"ny": tags[HEIGHT][0], "nx": tags[WIDTH][0], "dtype": f"{order}{kind}{tags[BITS][0] // 8}",
                      "codec": tags.get(COMPRESSION, (1,))[0], "at": list(tags[STRIP_AT]), "bytes": list(tags[STRIP_BYTES])})
        at = struct.unpack(order + "I", raw[12 * n:12 * n + 4])[0]
    return pages, text


def size_of(axis: str, description: str) -> int | None:
    """Extent along an axis from an OME or JSON description."""
    m = re.search(rf'Size{axis}="(\d+)"', description) or re.search(rf'"Size{axis}":\s*(\d+)', description)
    return int(m.group(1)) if m else None


def places(pages: int, description: str) -> tuple[list[dict], int, int]:
    """(t, c, z) of every page, number of planes and of times.

    The description gives the axes after x and y, the fastest first; without it planes come first, then channels, then times.
    """
    m = re.search(r'DimensionOrder="XY([CZT]{3})"', description)
    order = m.group(1) if m else "ZCT"
    size = {a: size_of(a, description) for a in "CZT"}
    size["C"], size["T"] = size["C"] or 1, size["T"] or 1
    size["Z"] = size["Z"] or pages // (size["C"] * size["T"])
    if size["C"] * size["Z"] * size["T"] != pages:
        raise ValueError(f"{pages} pages do not make {size['C']} channels of {size['Z']} planes at {size['T']} times")
    out = []
    for i in range(pages):
        at = {}
        for a in order:
            at[a] = i % size[a]
            i //= size[a]
        out.append({"t": at["T"], "c": at["C"], "blk_z": at["Z"]})
    return out, size["Z"], size["T"]


def read_tiff(spark: SparkSession, glob: str) -> DataFrame:
    """TIFF stacks as blocks of one plane: path, image, t, nt, c, block id, dims, bsize, v.

    Pages are placed by the dimension order that the file states.  Layouts that are not read raise an error.
    """
    files = spark.read.format("binaryFile").load(glob).select("path")
    fields = "path string, t bigint, nt bigint, c bigint, blk_z bigint, nz bigint, ny bigint, nx bigint, dtype string, codec int, at array<bigint>, bytes array<bigint>"

    def headers(batches):
        for pdf in batches:
            for path in pdf["path"]:
                pages, text = tiff_pages(path)
                where, nz, nt = places(len(pages), text)
                rows = [{"path": path, **w, "nt": nt, "nz": nz, **p} for w, p in zip(where, pages)]
                yield pd.DataFrame(rows, columns=[f.split(" ")[0] for f in fields.split(", ")])

    def planes(batches):
        for pdf in B.pieces(batches, lambda r: 8 * int(r.ny) * int(r.nx)):
            out = []
            for r in pdf.itertuples(index=False):
                data = b"".join(
                    zlib.decompress(d) if r.codec in (8, 32946) else d
                    for d in (read_range(r.path, int(o), int(n)) for o, n in zip(r.at, r.bytes)))
                if r.codec not in (1, 8, 32946):
                    raise ValueError(f"{r.path}: unsupported compression {r.codec}")
                v = np.frombuffer(data, dtype=np.dtype(r.dtype))[: r.ny * r.nx].astype(float)
                out.append([r.path, r.t, r.nt, r.c, r.blk_z, 0, 0, [r.nz, r.ny, r.nx], [1, r.ny, r.nx], v])
            yield pd.DataFrame(out, columns=["path", "t", "nt", "c", *B.BLK, "dims", "bsize", "v"])

    pages = files.mapInPandas(headers, fields).repartition("path", "t", "c", "blk_z")
    df = pages.mapInPandas(planes, "path string, t bigint, nt bigint, c bigint, blk_z bigint, blk_y bigint, blk_x bigint, dims array<bigint>, bsize array<bigint>, v array<double>")
    return df.withColumn("image", L.base_name("path"))


def ingest_tiff(spark: SparkSession, glob: str, out_root: str, bsize, dtype: str = "uint16", fmt: str = "zarr", subpath: str = "s0") -> int:
    """Any number of TIFF files -> one container each, `<out>/<name>.<fmt>/cN/<subpath>` (`cN/tN/<subpath>` with several times)."""
    from voxelloom.sources import chunked

    blocks = B.rechunk(read_tiff(spark, glob), bsize, keys=("image", "t", "nt", "c"))
    time = F.when(F.col("nt") > 1, F.concat(F.lit("/t"), F.col("t"))).otherwise("")
    folder = F.concat("image", F.lit(f".{fmt}/c"), F.col("c"), time, F.lit(f"/{subpath}"))
    return chunked.write(blocks, out_root, folder, fmt, dtype, "zlib" if fmt == "zarr" else "gzip")


def encode_nrrd(a: np.ndarray, codec: str = "gzip") -> bytes:
    kind = {"u1": "uint8", "u2": "uint16", "i4": "int32", "f4": "float", "f8": "double"}[a.dtype.str[1:]]
    head = (f"NRRD0004\ntype: {kind}\ndimension: {a.ndim}\nsizes: {' '.join(str(s) for s in a.shape[::-1])}\n"
            f"encoding: {codec}\nendian: little\n\n")
    data = a.astype(a.dtype.newbyteorder("<")).tobytes()
    return head.encode() + (gzip.compress(data, mtime=0) if codec == "gzip" else data)


#: NRRD type names.
NRRD_TYPES = {"uchar": "u1", "uint8": "u1", "unsigned char": "u1", "char": "i1", "int8": "i1", "ushort": "u2", "uint16": "u2",
              "unsigned short": "u2", "short": "i2", "int16": "i2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4",
              "float": "f4", "double": "f8"}


def decode_nrrd(data: bytes) -> np.ndarray:
    head, body = data.split(b"\n\n", 1)
    lines = [s for s in head.decode().splitlines()[1:] if not s.startswith("#")]
    f = {k.strip(): v.strip() for k, v in (s.split(":", 1) for s in lines if ": " in s)}
    body = gzip.decompress(body) if f["encoding"] in ("gzip", "gz") else body
    order = ">" if f.get("endian") == "big" else "<"
    return np.frombuffer(body, dtype=order + NRRD_TYPES[f["type"]]).reshape([int(s) for s in f["sizes"].split()][::-1])


def read_nrrd(spark: SparkSession, glob: str) -> DataFrame:
    """NRRD volumes (masks) as blocks of one plane: path, image, block id, dims, bsize, v."""
    files = spark.read.format("binaryFile").load(glob).select("path", "content")

    def decode(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                a = decode_nrrd(content)
                nz, ny, nx = a.shape
                yield pd.DataFrame({"path": path, "blk_z": range(nz), "blk_y": 0, "blk_x": 0, "dims": [[nz, ny, nx]] * nz,
                                    "bsize": [[1, ny, nx]] * nz, "v": [p.ravel().astype(float) for p in a]})

    schema = "path string, blk_z bigint, blk_y bigint, blk_x bigint, dims array<bigint>, bsize array<bigint>, v array<double>"
    return files.mapInPandas(decode, schema).withColumn("image", L.base_name("path"))
