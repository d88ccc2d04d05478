"""Image files made from the fixture volumes, as input for the readers.

Fixture images have a fixed size, so one image is a bounded group; only the number of
images grows with the tables.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators import blocks as B
from voxelloom.sources.files import write_file
from voxelloom.sources.images import encode_nrrd, encode_tiff


def write_tiff(blocks: DataFrame, root: str, name, keys=("ds", "c"), channel: str = "c", dtype: str = "uint16", deflate=True) -> int:
    """Block table -> one TIFF stack per dataset (small exports; a stack is one file).  Blocks meet as they are, not as voxel rows."""
    others = [k for k in keys if k != channel]
    rows = blocks.select(name.alias("name"), *keys, *B.BLK, "dims", "bsize", "v")

    def put(pdf: pd.DataFrame) -> pd.DataFrame:
        cs = sorted(pdf[channel].unique())
        boxes = [(B.core_origin(row), B.core_shape(row)) for row in pdf.itertuples(index=False)]
        shape = [max(o[i] + n[i] for o, n in boxes) for i in range(3)]
        pages = []
        for c in cs:
            a = np.zeros(shape, dtype=dtype)
            for (o, n), own, v in zip(boxes, pdf[channel], pdf["v"]):
                if own == c:
                    a[tuple(slice(i, i + k) for i, k in zip(o, n))] = np.asarray(v).reshape(n)
            pages.extend(a)
        text = json.dumps({"SizeC": len(cs), "SizeZ": shape[0]})
        write_file(f"{root.rstrip('/')}/{pdf['name'].iloc[0]}.tif", encode_tiff(pages, deflate, text))
        return pd.DataFrame({"n": [len(pages)]})

    return int(rows.groupBy(*others).applyInPandas(put, "n bigint").agg(F.sum("n")).first()[0])


def write_nrrd(vox: DataFrame, root: str, name, keys=("ds",), col="m", dtype="uint8") -> int:
    """Mask voxels -> one NRRD file per key (low-resolution masks)."""

    def put(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros([int(pdf[k].max()) + 1 for k in "zyx"], dtype=dtype)
        a[pdf["z"], pdf["y"], pdf["x"]] = pdf["v"].to_numpy()
        write_file(f"{root.rstrip('/')}/{pdf['name'].iloc[0]}.nrrd", encode_nrrd(a))
        return pd.DataFrame({"n": [a.size]})

    rows = vox.select(name.alias("name"), *keys, "z", "y", "x", F.col(col).alias("v"))
    return int(rows.groupBy(*keys).applyInPandas(put, "n bigint").agg(F.sum("n")).first()[0])
