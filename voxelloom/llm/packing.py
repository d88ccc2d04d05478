"""Best-fit packing of documents into bins of equal capacity, with conflicts.

A bin holds no two pieces of one source and no two of one duplicate cluster.  Only ids, sizes, sources and clusters are
packed, never texts.  Pieces are packed in runs of bounded size inside the tasks that read them, so nothing is shuffled
and no group is ever gathered: copies or a hot source only meet in one run by chance.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm import words as W

SCHEMA = "doc_id long, piece int, first long, size long, bin_id long, slot int, bin_fill long"


def best_fit(sizes, sources, clusters, capacity: int) -> tuple[list[int], list[int]]:
    """(bin of each piece, fill of each bin), largest pieces first; ties in the given order.

    Open bins are kept by (room left, bin).  A piece looks for the first bin with enough room and goes on to the next
    roomier one until neither its source nor its cluster is in the bin's bitmap: the tightest compatible bin.
    Source or cluster None conflicts with nothing.
    """
    bits: dict = {None: 0}

    def bit(kind, value):
        if value is None:
            return 0
        return bits.setdefault((kind, value), 1 << (len(bits) - 1))

    masks = [bit("s", s) | bit("c", c) for s, c in zip(sources, clusters)]
    room: list[tuple[int, int]] = []
    held: list[int] = []
    fill: list[int] = []
    placed = [0] * len(masks)
    for i in sorted(range(len(masks)), key=lambda i: -sizes[i]):
        size, mask = sizes[i], masks[i]
        at = bisect_left(room, (size, -1))
        while at < len(room) and held[room[at][1]] & mask:
            at += 1
        if at < len(room):
            left, target = room.pop(at)
            held[target] |= mask
        else:
            left, target = capacity, len(held)
            held.append(mask)
            fill.append(0)
        fill[target] += size
        placed[i] = target
        if left > size:
            insort(room, (left - size, target))
    return placed, fill


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", capacity: int = 2048, run: int = 4096,
         cluster: str | None = None) -> DataFrame:
    """(doc_id, piece, first, size, bin_id, slot, bin_fill): every piece of every document in a bin.

    Sizes are words (`[^\\x20\\x09-\\x0D]+`).  A document of more than `capacity` words is cut into pieces of `capacity`
    words and a rest; `first` is the first word of a piece.  Documents without words (null, empty) are one piece of size 0.
    The duplicate cluster is the column `cluster` (say the component of near-copies; null: none), by default a hash of the whole
    text (null texts: none); a null source conflicts with nothing.  Full
    pieces have bins of their own.  `run` pieces are packed together.  Repeated rows are separate pieces, told apart by
    their bin and slot.  Bin ids are unique: task number times 2^40 plus a count.
    """
    facts = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
        (F.when(F.col(text).isNotNull(), F.xxhash64(text)) if cluster is None else F.col(cluster).cast("string")).alias("cluster"), F.col(text).alias("text"),
    )

    def pieces(batches):
        for whole in batches:
            for batch in W.slices(whole, "text"):
                data, offsets = W.flat(batch.column(3))
                _, _, first = W.bounds(data, offsets, W.BLANK)
                words = np.diff(first)
                count = np.maximum(-(-words // capacity), 1)
                row = np.repeat(np.arange(len(words)), count)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                size = np.minimum(words[row] - nth * capacity, capacity)
                ids, sources, clusters = (batch.column(i).to_pylist() for i in range(3))
                for r, n, s in zip(row.tolist(), nth.tolist(), size.tolist()):
                    yield ids[r], n, n * capacity, s, sources[r], clusters[r]

    def packed(batches):
        base, done = TaskContext.get().partitionId() << 40, 0
        held = []

        def flush():
            nonlocal done
            ids, nth, first, size, sources, clusters = zip(*held)
            placed, fill = best_fit(size, sources, clusters, capacity)
            order = np.argsort(placed, kind="stable")
            bins = np.array(placed)[order]
            slot = np.arange(len(bins)) - np.searchsorted(bins, bins)
            pick = [np.array([c[i] for i in order], dtype=object) for c in (ids, nth, first, size)]
            out = pa.RecordBatch.from_arrays([
                pa.array(pick[0].tolist(), pa.int64()), pa.array(pick[1].tolist(), pa.int32()), pa.array(pick[2].tolist(), pa.int64()),
                pa.array(pick[3].tolist(), pa.int64()), pa.array(bins + base + done), pa.array(slot.astype(np.int32)),
                pa.array(np.array(fill)[bins]),
            ], names=["doc_id", "piece", "first", "size", "bin_id", "slot", "bin_fill"])
            done += len(fill)
            held.clear()
            return out

        for piece in pieces(batches):
            held.append(piece)
            if len(held) == run:
                yield flush()
        if held:
            yield flush()

    return facts.mapInArrow(packed, SCHEMA)
