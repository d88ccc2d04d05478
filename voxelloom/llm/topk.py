"""Exact top-k inner products by a pivot-distance index.

Vectors get one more coordinate sqrt(M - |v|^2), M the largest squared length, and queries a 0 there.  Then
|q - v|^2 = |q|^2 + M - 2 q.v, so the largest inner products are the nearest vectors and distances obey the triangle
inequality.  Every vector is keyed by its nearest pivot and its distance to it; runs of neighbours in that order are
annuli of bounded size.  By the triangle inequality an annulus [a, b] around a pivot at distance d from a query holds
nothing nearer than max(a - d, d - b, 0).

1. A query first searches the annuli of its own part of the index, nearest first, until the bound stops it.  That gives
   its k-th score so far.
2. Blocks of queries are joined only with annuli that may still hold a better score; inside, each pair is tested again
   with the best scores seen by the task, and the partial results are merged by query.

Scores are exact whole numbers.  Only pivots and the bounds of annuli are broadcast; both have fixed limits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.llm.setup import stored

#: Annuli in all at most; with more rows they get larger.
ANNULI = 1 << 18
_ROW = "pivot int, dist double, id long, dims int, query boolean, vec binary, squared double"
_BLOCK = "part int, annulus long, pivot int, dims int, low double, high double, n int, ids binary, vecs binary, best binary"
_HITS = "query_id long, vec_id long, score long"
_HIT_KIND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_EDGE = 1 << 31


def whole(vector: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as whole numbers held in doubles; parts beyond 32 bits are held at that limit."""
    return np.clip(np.floor(vector.astype(np.float64) * scale), -_EDGE, _EDGE)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows, held at the limits of 64 bits."""
    if not len(q) or not len(v):
        return np.zeros((len(q), len(v)), dtype=np.int64)
    limit = float(np.sqrt((q * q).sum(1).max()) * np.sqrt((v * v).sum(1).max()))
    if limit < 2.0 ** 52:
        return (q @ v.T).astype(np.int64)
    exact = q.astype(np.int64).astype(object) @ v.astype(np.int64).astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[scores >= cut], scores[scores >= cut]
    order = np.lexsort((ids, -scores.astype(np.float64), ~scores))[:k]
    return ids[order], scores[order]


class Pivots:
    """Pivot vectors by number of dimensions, the largest squared length of each, and distances to them."""

    def __init__(self, samples: dict[int, np.ndarray], largest: dict[int, float], count: int):
        self.largest = largest
        self.points, self.base, at = {}, {}, 0
        for dims, rows in sorted(samples.items()):
            lifted = self.lift(rows, (rows * rows).sum(1), dims)
            chosen = [0]
            near = ((lifted - lifted[0]) ** 2).sum(1)
            while len(chosen) < min(count, len(lifted)) and near.max() > 0:  # farthest-first
                chosen.append(int(near.argmax()))
                near = np.minimum(near, ((lifted - lifted[chosen[-1]]) ** 2).sum(1))
            self.points[dims], self.base[dims] = lifted[chosen], at
            at += len(chosen)

    def lift(self, rows: np.ndarray, squared: np.ndarray, dims: int) -> np.ndarray:
        return np.concatenate((rows, np.sqrt(np.maximum(self.largest[dims] - squared, 0))[:, None]), 1)

    def distances(self, lifted: np.ndarray, dims: int) -> np.ndarray:
        p = self.points[dims]
        return np.sqrt(np.maximum((lifted * lifted).sum(1)[:, None] + (p * p).sum(1) - 2 * lifted @ p.T, 0))


def _bound(squared, largest: float, distance):
    """No score of anything at `distance` or farther is above this."""
    return (squared + largest - np.maximum(distance, 0) ** 2) / 2 + 1e-6 * (squared + largest + 1) + 1


def top(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", query=None, k: int = 5, scale: float = 256.0,
        pivots: int = 48, sample: int = 4096, annulus: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest scores of every query row against every other row, ties to the smaller id.

    `query`: a condition on the rows (none: all rows).  Components become floor(scale * x).  Vectors that are null or hold a
    null or non-finite component, and rows with a null id, take no part; vectors of different lengths do not meet; a row's own id is no
    candidate, also where it repeats; a repeated candidate id counts once with its best score; repeated query rows give one
    result with the best scores of all of them.  Fewer than k candidates give fewer ranks.  Scores are held at the limits of 64 bits, components at 32.

    Pivots come from at most `sample` rows of each length (an index choice only: every row is indexed, every bound holds).
    """
    spark = vectors.sparkSession
    value = F.col(vector)
    sound = value.isNotNull() & ~F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(sound & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), (F.lit(True) if query is None else F.coalesce(query, F.lit(False))).alias("query"),
        value.cast("array<double>").alias("vector"))

    def pack(batches):
        for batch in batches:
            column = batch.column(2)
            data = whole(column.flatten().to_numpy(), scale)
            size = np.diff(column.offsets.to_numpy())
            first = np.cumsum(size) - size
            vecs = [data[a:a + n] for a, n in zip(first.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(size.astype(np.int32)),
                pa.array([x.astype(np.int64).astype(np.float64).tobytes() if len(x) else b"" for x in vecs], pa.binary()),
                pa.array([float(x @ x) for x in vecs], pa.float64())], names=["id", "query", "dims", "vec", "squared"])

    packed = rows.mapInArrow(pack, "id long, query boolean, dims int, vec binary, squared double")
    facts = packed.groupBy("dims").agg(F.max("squared").alias("most"), F.count("*").alias("n")).collect()  # one row a length
    if not facts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    share = min(1.0, sample / max(r.n for r in facts))
    lucky = F.lit(True) if share == 1 else F.xxhash64("id").bitwiseAND(F.lit((1 << 40) - 1)) <= F.lit(int(share * (1 << 40)))
    taken = packed.where(lucky).groupBy("dims").agg(F.slice(F.sort_array(F.collect_list(F.struct("id", "vec"))), 1, sample).alias("rows")).collect()
    samples = {r.dims: np.stack([np.frombuffer(bytes(x.vec), np.float64) for x in r.rows]) for r in taken if r.rows}
    for r in facts:
        samples.setdefault(r.dims, np.zeros((1, r.dims)))
    known = spark.sparkContext.broadcast(Pivots(samples, {r.dims: float(r.most) for r in facts}, pivots))
    total = sum(r.n for r in facts)
    width = max(annulus, -(-total // ANNULI))
    parts = max(1, -(-total // (width * 16)))

    def place(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            pivot, dist = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.unique(dims).tolist():
                here = np.flatnonzero(dims == d)
                vecs = np.frombuffer(b"".join(batch.column(3).take(pa.array(here)).to_pylist()), np.float64).reshape(len(here), d)
                away = known.value.distances(known.value.lift(vecs, (vecs * vecs).sum(1), d), d)
                pivot[here] = away.argmin(1) + known.value.base[d]
                dist[here] = away.min(1)
            yield pa.RecordBatch.from_arrays([pa.array(pivot), pa.array(dist), batch.column(0), batch.column(2), batch.column(1), batch.column(3), batch.column(4)],
                                             names=["pivot", "dist", "id", "dims", "query", "vec", "squared"])

    placed = packed.mapInArrow(place, _ROW).repartitionByRange(parts, "pivot", "dist", "id").sortWithinPartitions("pivot", "dist", "id")
    index = stored(placed.withColumn("part", F.spark_partition_id()).mapInArrow(_annuli(known, width, k), _BLOCK), "annuli")
    bounds = index.select("annulus", "pivot", "dims", "low", "high").toPandas().to_numpy()  # at most ANNULI and one a pivot and part
    edges = spark.sparkContext.broadcast(bounds)
    # queries travel in the blocks of the index they belong to
    asked = index.where(F.octet_length("best") > 0).select(F.col("annulus").alias("block"), "dims", F.col("best").alias("asked"))
    wanted = asked.mapInArrow(_wanted(known, edges), "annulus long, block long")
    pairs = wanted.join(asked.select("block", "asked"), "block").join(index.select("annulus", "pivot", "dims", "low", "high", "ids", "vecs"), "annulus")
    found = pairs.mapInArrow(_search(known, k), _HITS)
    first = asked.mapInArrow(_seeds(k), _HITS)
    best = found.unionByName(first).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _seal(ids, vecs, scores, others) -> bytes:
    """Queries of an annulus with their best scores so far, as one value."""
    head = np.array([len(ids), vecs.shape[1], scores.shape[1]], np.int64)
    return b"".join((head.tobytes(), ids.astype(np.int64).tobytes(), vecs.astype(np.float64).tobytes(), scores.tobytes(), others.tobytes()))


def _unseal(data: bytes):
    n, dims, k = np.frombuffer(data, np.int64, 3).tolist()
    sizes = np.cumsum((24, 8 * n, 8 * n * dims, 8 * n * k, 8 * n * k))
    ids, vecs, scores, others = (np.frombuffer(data[a:b], t) for a, b, t in zip(sizes[:-1], sizes[1:], (np.int64, np.float64, np.int64, np.int64)))
    return ids, vecs.reshape(n, dims), scores.reshape(n, k), others.reshape(n, k)


#: A score that no pair has: fewer than k candidates so far.
_NONE = -(1 << 63)


def _annuli(known, width: int, k: int):
    """Rows in index order to annuli, with the queries among them and what they find in their own part."""

    def run(batches):
        batches = list(batches)  # one part: `width` * 16 rows or so
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        pivot, dist, ids, dims = (table.column(c).to_numpy() for c in ("pivot", "dist", "id", "dims"))
        asks, raw = table.column("query").to_numpy(), table.column("vec").to_pylist()
        part = int(table.column("part")[0].as_py())
        edge = np.flatnonzero(np.diff(pivot)) + 1
        cuts = sorted({0, len(ids), *edge.tolist(), *(x for a, b in zip([0, *edge], [*edge, len(ids)]) for x in range(int(a), int(b), width))})
        blocks = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            d = int(dims[a])
            blocks.append((a, b, int(pivot[a]), d, float(dist[a]), float(dist[b - 1]), np.frombuffer(b"".join(raw[a:b]), np.float64).reshape(b - a, d)))
        for i, (a, b, p, d, low, high, vecs) in enumerate(blocks):
            mine = np.flatnonzero(asks[a:b])
            best = b""
            if len(mine):
                q = vecs[mine]
                squared = (q * q).sum(1)
                away = known.value.distances(np.concatenate((q, np.zeros((len(q), 1))), 1), d)
                scores, others = np.full((len(mine), k), _NONE), np.full((len(mine), k), -1)
                near = [j for j in range(len(blocks)) if blocks[j][3] == d]
                gap = {j: np.maximum(np.maximum(blocks[j][4] - away[:, blocks[j][2] - known.value.base[d]], away[:, blocks[j][2] - known.value.base[d]] - blocks[j][5]), 0) for j in near}
                for j in sorted(near, key=lambda j: (float(gap[j].min()), abs(j - i))):
                    open_ = np.flatnonzero(_bound(squared, known.value.largest[d], gap[j]) >= scores[:, -1])
                    _merge(scores, others, open_, ids[a:b][mine], q, ids[blocks[j][0]:blocks[j][1]], blocks[j][6], k)
                best = _seal(ids[a:b][mine], q, scores, others)
            yield pa.RecordBatch.from_pydict({
                "part": [part], "annulus": [(part << 32) + i], "pivot": [p], "dims": [d], "low": [low], "high": [high], "n": [b - a],
                "ids": [ids[a:b].tobytes()], "vecs": [vecs.tobytes()], "best": [best]}, pa.schema([
                    ("part", pa.int32()), ("annulus", pa.int64()), ("pivot", pa.int32()), ("dims", pa.int32()), ("low", pa.float64()),
                    ("high", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("vecs", pa.binary()), ("best", pa.binary())]))

    return run


def _merge(scores, others, open_, query_ids, q, ids, vecs, k: int) -> None:
    """Better candidates of a block into the best lists of the open queries."""
    for at in range(0, len(open_), 256):
        rows = open_[at:at + 256]
        found = products(q[rows], vecs)
        for r, line in zip(rows.tolist(), found):
            ok = (line >= scores[r, -1]) & (ids != query_ids[r])
            if not ok.any():
                continue
            had = others[r] != -1
            had = had | (scores[r] != _NONE)
            a, b = np.concatenate((others[r][had], ids[ok])), np.concatenate((scores[r][had], line[ok]))
            order = np.lexsort((-b.astype(np.float64), a))  # a repeated candidate: its best score
            a, b = a[order], b[order]
            first = np.concatenate(([True], a[1:] != a[:-1]))
            a, b = _best(a[first], b[first], k)
            others[r], scores[r] = -1, _NONE
            others[r, :len(a)], scores[r, :len(b)] = a, b


def _wanted(known, edges):
    """(annulus, block of queries) wherever a query of the block may find a better score; not in its own part."""

    def run(batches):
        table = edges.value
        annulus, pivot, dims, low, high = table[:, 0].astype(np.int64), table[:, 1].astype(np.int64), table[:, 2].astype(np.int64), table[:, 3], table[:, 4]
        for batch in batches:
            for block, d, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                _, q, scores, _ = _unseal(data)
                squared = (q * q).sum(1)
                away = known.value.distances(np.concatenate((q, np.zeros((len(q), 1))), 1), d)
                here = np.flatnonzero((dims == d) & (annulus >> 32 != block >> 32))
                out = []
                for at in range(0, len(here), 4096):
                    some = here[at:at + 4096]
                    gap = away[:, pivot[some] - known.value.base[d]]
                    gap = np.maximum(np.maximum(low[some] - gap, gap - high[some]), 0)
                    open_ = _bound(squared[:, None], known.value.largest[d], gap) >= scores[:, -1:]
                    out.append(annulus[some][open_.any(0)])
                out = np.concatenate(out) if out else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(np.full(len(out), block))], names=["annulus", "block"])

    return run


def _search(known, k: int):
    """Partial best lists of the queries in joined (block of queries, annulus) rows, kept up by the task."""

    def run(batches):
        held: dict[int, list] = {}

        def hits():
            for ids, _, scores, others in held.values():
                yield from _hits(ids, scores, others)
            held.clear()

        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            for block, asked, p, d, low, high, ids, vecs in zip(*(get(c).to_pylist() for c in ("block", "asked", "pivot", "dims", "low", "high", "ids", "vecs"))):
                if block not in held:
                    if len(held) >= 256:
                        yield from hits()
                    held[block] = [x.copy() for x in _unseal(asked)]
                query_ids, q, scores, others = held[block]
                squared = (q * q).sum(1)
                away = known.value.distances(np.concatenate((q, np.zeros((len(q), 1))), 1), d)[:, p - known.value.base[d]]
                gap = np.maximum(np.maximum(low - away, away - high), 0)
                open_ = np.flatnonzero(_bound(squared, known.value.largest[d], gap) >= scores[:, -1])
                ids = np.frombuffer(ids, np.int64)
                _merge(scores, others, open_, query_ids, q, ids, np.frombuffer(vecs, np.float64).reshape(len(ids), d), k)
        yield from hits()

    return run


def _hits(ids, scores, others):
    row, col = np.nonzero(scores != _NONE)
    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(others[row, col]), pa.array(scores[row, col])], schema=_HIT_KIND)


def _seeds(k: int):
    def run(batches):
        for batch in batches:
            for data in batch.column(2).to_pylist():
                ids, _, scores, others = _unseal(data)
                yield from _hits(ids, scores, others)

    return run
