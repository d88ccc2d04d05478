"""SimHash near-dedup: fingerprints of word shingles, linked by a grid range-join on segment popcounts.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments.  The Manhattan distance of two such
vectors is never above the Hamming distance, so a pair within `distance` bits is within `distance` of each other in the
grid, and then one half of the vector (16 segments) is within distance // 2.  Points are keyed by the cell of each half;
on one side of the join also by the neighbouring cells within distance // 2.  Pairs that meet are tested by the whole
Manhattan bound and then exactly.  Equal fingerprints are one point.  A cell sends a spanning forest of its links
instead of all pairs; cells with very many points are split into pairs of parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.llm import words as W
from voxelloom.llm.graph import components
from voxelloom.llm.setup import stored, unused
from voxelloom.operators.blocks import never_broadcast

#: Points of a cell that one task compares with one another; larger cells are split.
CELL = 8192
_LOW = np.uint64(0x5555555555555555)


def fingerprint(words: list[bytes], k: int, seed: int) -> int:
    """Bits that are set in more than half of the shingles' hashes (repeats count); no word: 0."""
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = max(len(words) - k + 1, 1)
    last = end[-n:]
    digest = xxhash.xxh64_intdigest
    hashed = np.array([digest(joined[a:b], seed) for a, b in zip(start[:n].tolist(), last.tolist())], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashed[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", k: int = 3, seed: int = 42, name: str = "fp") -> DataFrame:
    """`docs` without its text but with the fingerprint of the whole text (long).

    A-Z are lower-cased; words are `[^\\x20\\x09-\\x0D]+`; fewer than k words are one shingle; no word or null is 0.
    """
    rest = docs.drop(text, name)
    names = rest.columns

    def run(batches):
        for whole in batches:
            for batch in W.slices(whole, text):
                data, offsets = W.flat(batch.column(batch.schema.get_field_index(text)))
                lower = W.LOWER[data].tobytes()
                out = np.array([fingerprint(lower[a:b].split(), k, seed) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], dtype=np.uint64)
                columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out.view(np.int64))], names=[*names, name])

    wanted = docs.select(text, *[F.col(f"`{c}`") for c in names])
    return wanted.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(name, T.LongType())]))


def embed(points: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 segments, two bits each, packed in one number."""
    return (points & _LOW) + ((points >> np.uint64(1)) & _LOW)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed vectors whose parts are 0, 1 or 2."""
    # |x - y| of 2-bit parts: 1 where the low bits differ, 2 where one is 0 and the other 2
    low = (a ^ b) & _LOW
    high = ((a ^ b) >> np.uint64(1)) & _LOW & ~low
    return np.bitwise_count(low) + 2 * np.bitwise_count(high)


def _neighbours(half: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(point, cell) of all cells within `reach` of each half vector, itself left out."""
    at, cell = np.arange(len(half)), half
    seen = [(at, cell)]
    for _ in range(reach):
        grown = []
        for segment in range(16):
            value = (cell >> np.uint64(2 * segment)) & np.uint64(3)
            for ok, step in ((value < 2, 1), (value > 0, -1)):
                grown.append((at[ok], cell[ok] + np.uint64(1 << 2 * segment) if step > 0 else cell[ok] - np.uint64(1 << 2 * segment)))
        at, cell = (np.concatenate(x) for x in zip(*grown))
        seen.append((at, cell))
    at, cell = (np.concatenate(x) for x in zip(*seen))
    pairs = np.unique(np.stack((at.astype(np.uint64), cell), 1), axis=0)
    pairs = pairs[pairs[:, 1] != half[pairs[:, 0].astype(np.int64)]]
    return pairs[:, 0].astype(np.int64), pairs[:, 1]


def _forest(left: np.ndarray, right: np.ndarray, same: bool, distance: int) -> list[tuple[int, int]]:
    """Links between two lists of points (or within one) that span what is linked."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    own, other = embed(left), embed(right)
    step = 1024
    for i in range(0, len(left), step):
        for j in range(i if same else 0, len(right), step):
            near = manhattan(own[i:i + step, None], other[None, j:j + step]) <= distance
            a, b = np.nonzero(near)
            a, b = left[i + a], right[j + b]
            ok = (np.bitwise_count(a ^ b) <= distance) & (a != b)
            for x, y in zip(a[ok].tolist(), b[ok].tolist()):
                p, q = root(x), root(y)
                if p != q:
                    parent[p] = q
                    out.append((x, y))
    return out


def links(points: DataFrame, fp: str = "fp", distance: int = 3) -> DataFrame:
    """(a, b): links that join all distinct fingerprints within `distance` bits, by chains of such links."""
    reach = distance // 2

    def cells(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            vector = embed(fps)
            parts = []
            for half in (0, 1):
                own = (vector >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
                at, near = _neighbours(own, reach)
                key = np.concatenate((own, near)).astype(np.int64) * 2 + half
                parts.append((key, np.concatenate((fps, fps[at])), np.concatenate((np.zeros(len(fps), bool), np.ones(len(at), bool)))))
            key, point, probe = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(point.view(np.int64)), pa.array(probe)], names=["cell", "fp", "probe"])

    placed = points.select(F.col(fp).alias("fp")).mapInArrow(cells, "cell long, fp long, probe boolean")
    # only cells where two points meet matter, and at least one of them lives there
    counts = placed.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.when(F.col("probe"), 0).otherwise(1)).alias("own"))
    met = counts.where("n > 1 and own > 0").select("cell", F.ceil(F.col("n") / CELL).alias("parts"))
    # Spark takes what a row of points becomes, some 45 cells, for one row
    placed = never_broadcast(placed).join(met, "cell")
    part = F.pmod(F.xxhash64("fp"), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(part, j).alias("i"), F.greatest(part, j).alias("j")))
    spread = placed.select("cell", "fp", "probe", part.alias("part"), F.explode(pairs).alias("pair")).select("cell", "pair.i", "pair.j", "fp", "probe", "part")

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        fps = table.column("fp").to_numpy().view(np.uint64)
        probe = table.column("probe").to_numpy()
        part = table.column("part").to_numpy()
        out = []
        if i == j:
            home = fps[~probe]
            out += _forest(home, home, True, distance) + _forest(home, fps[probe], False, distance)
        else:
            for x, y in ((i, j), (j, i)):
                home = fps[~probe & (part == x)]
                out += _forest(home, fps[(part == y) & (probe | (x < y))], False, distance)
        pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return spread.groupBy("cell", "i", "j").applyInArrow(compare, "a long, b long")


def group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, seed: int = 42, distance: int = 3) -> DataFrame:
    """(doc_id, key, fp, component_id) of every row, key a hash of its text: documents joined by chains of fingerprints within `distance` bits.

    component_id is the smallest doc_id of the component.  Null, empty and wordless texts have fingerprint 0 and link
    like any other; rows with equal ids stay rows; a component whose ids are all null has a null component_id.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    prints = stored(fingerprints(rows, "text", k, seed), "fingerprints")
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(points, "fp", distance)).withColumnsRenamed({"node": "fp"})
    labelled = points.join(never_broadcast(roots), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    found = labelled.select("fp", "root").join(never_broadcast(lowest), "root").drop("root")
    return never_broadcast(prints).join(found, "fp").select("doc_id", "key", "fp", "component_id")


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each component, the one with the smallest id, unchanged.

    Rows that repeat both id and text are one document and stay together; rows with a null id stay.
    """
    groups = group(docs, doc_id, text, **options)
    own, key = unused(docs, "__id", "__key")
    losers = groups.where("doc_id > component_id").select(F.col("doc_id").alias(own), F.col("key").alias(key)).distinct()
    same = (F.col(f"`{doc_id}`").cast("long") == F.col(own)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(key))
    return docs.join(losers, same, "left_anti")
