"""Substring dedup: repeated word windows found with a count-min prefilter and an exact second pass.

1. Every task counts its windows in a sparse count-min sketch (rows of hash cells, sorted and delta-coded); the
   sketches are merged segment by segment.  A cell's count is never below a window's count.
2. Windows whose cells all say "at least twice" are grouped exactly by a 96-bit key.  A task first groups its own
   run of documents: of each window it sends the occurrence with the smallest document id only and marks the others
   itself, so a window that stands everywhere sends one entry per run and never makes a large group.
3. Marks come back to their documents, and the covered words are taken out.

The sketch is the only thing broadcast and has at most `sketch_bits` bits.  On a corpus for which that is too small it
sorts out fewer windows and the exact pass gets more; the result is the same.
"""

from __future__ import annotations

import struct
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.llm import words as W
from voxelloom.llm.setup import aside
from voxelloom.operators.blocks import never_broadcast

#: Cells of a sketch segment.
SEGMENT = 1 << 22
#: Windows that a task holds before it sends what it has.
HELD = 1 << 20
#: Bytes of text hashed at a time: its temporaries, and what HELD is overshot by, follow from it.
SLICE = 1 << 20
ADDED = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()),
    T.StructField("removed", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))),
])
_ID, _KEY, _STARTS, _SIZES = "__id", "__key", "__starts", "__sizes"


def pack(values: np.ndarray) -> bytes:
    """Sorted cells as compressed differences."""
    step = np.diff(values, prepend=values[:1])
    kind = np.uint16 if not len(step) or step.max() < 1 << 16 else np.uint32
    head = struct.pack("<?IQ", kind is np.uint32, int(values[0]) if len(values) else 0, len(values))
    return head + zstandard.compress(step.astype(kind).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    wide, base, n = struct.unpack_from("<?IQ", data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    step = np.frombuffer(zstandard.decompress(data[struct.calcsize("<?IQ"):]), np.uint32 if wide else np.uint16)
    return np.cumsum(step, dtype=np.int64) + base


def cells(hashed: np.ndarray, row: int, width: int) -> np.ndarray:
    """Cell of each window in a row of the sketch; rows use different halves of the hash."""
    half = (hashed >> np.uint64(32)) if row == 0 else (hashed & np.uint64(0xFFFFFFFF))
    return (half * np.uint64(width)) >> np.uint64(32)


def _hashed(batches, text: str, window: int, both: bool):
    """(rows, their first words, start word and row of every window, its one or two hashes), slice by slice."""
    for whole in batches:
        for batch in W.slices(whole, text, SLICE):
            data, offsets = W.flat(batch.column(batch.schema.get_field_index(text)))
            starts, ends, first = W.bounds(data, offsets, W.BLANK)
            at, row = W.whole(first, window)
            found = [W.windows(W.hashes(data, starts, ends, seed), window)[at] for seed in W.SEEDS[:1 + both]]
            yield batch, at - first[row], row, found


def _sketch_rows(cell_parts: list[list[np.ndarray]]):
    """(segment, once, twice) of what a task holds, which is let go; segment counts on over the rows of the sketch."""
    out = {"segment": [], "once": [], "twice": []}
    for row, parts in enumerate(cell_parts):
        joined = np.concatenate(parts)
        parts.clear()
        values, counts = np.unique(joined, return_counts=True)
        del joined
        which = values // SEGMENT
        edges = np.concatenate(([0], np.flatnonzero(np.diff(which)) + 1, [len(values)])) if len(values) else [0, 0]
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            inside = (values[a:b] % SEGMENT).astype(np.int64)
            out["segment"].append(int(which[a]) * len(cell_parts) + row)
            out["once"].append(pack(inside[counts[a:b] == 1]))
            out["twice"].append(pack(inside[counts[a:b] > 1]))
    return pa.RecordBatch.from_pydict(out, pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))


def sketch(docs: DataFrame, text: str, window: int, depth: int, width: int) -> DataFrame:
    """Partition sketches merged: (segment, bits of the cells that count at least two)."""

    def count(batches):
        held, n = [[] for _ in range(depth)], 0
        for _, _, _, (hashed,) in _hashed(batches, text, window, False):
            for row in range(depth):
                held[row].append(cells(hashed, row, width).astype(np.uint32))
            n += len(hashed)
            if n >= HELD:
                yield _sketch_rows(held)
                held, n = [[] for _ in range(depth)], 0
        if n:
            yield _sketch_rows(held)

    def merge(batches):
        current, once, twice = None, None, None

        def done():
            bits = np.packbits(twice, bitorder="little").tobytes()
            return pa.RecordBatch.from_pydict({"segment": [current], "bits": [zstandard.compress(bits, 1)]},
                                              pa.schema([("segment", pa.int32()), ("bits", pa.binary())]))

        for batch in batches:  # rows come sorted by segment
            for segment, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if segment != current:
                    if current is not None:
                        yield done()
                    current, once, twice = segment, np.zeros(SEGMENT, dtype=bool), np.zeros(SEGMENT, dtype=bool)
                a, b = unpack(a), unpack(b)
                twice[a[once[a]]] = True
                once[a] = True
                once[b] = twice[b] = True
        if current is not None:
            yield done()

    parts = docs.select(text).mapInArrow(count, "segment int, once binary, twice binary")
    return parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, bits binary")


def _blocks(part, ids, keys, pos, *more):
    """(part, packed places) for each part: documents once, positions as differences, other columns as they are."""
    order = np.lexsort((pos, keys, ids, part))
    part, ids, keys, pos = part[order], ids[order], keys[order], pos[order]
    edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)])) if len(part) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        fresh = np.ones(b - a, dtype=bool)
        fresh[1:] = (ids[a + 1:b] != ids[a:b - 1]) | (keys[a + 1:b] != keys[a:b - 1])
        docs = np.flatnonzero(fresh) + a
        parts = [
            zstandard.compress(np.concatenate((ids[docs], keys[docs], np.diff(docs, append=b))).tobytes(), 1),
            zstandard.compress(np.diff(pos[a:b], prepend=0).astype(np.int32).tobytes(), 1),
            *(x[order[a:b]].tobytes() for x in more),
        ]
        yield int(part[a]), struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)


def _opened(data: bytes, kinds=()):
    """(ids, keys, positions, other columns) of packed places."""
    n = 2 + len(kinds)
    edges = np.cumsum((8 * n, *struct.unpack_from(f"<{n}Q", data)))
    docs, step, *more = (data[a:b] for a, b in zip(edges[:-1], edges[1:]))
    ids, keys, counts = np.frombuffer(zstandard.decompress(docs), np.int64).reshape(3, -1)
    pos = np.cumsum(np.frombuffer(zstandard.decompress(step), np.int32), dtype=np.int64)
    return np.repeat(ids, counts), np.repeat(keys, counts), pos, *map(np.frombuffer, more, kinds)


_SENT = pa.schema([("bucket", pa.int64()), ("entries", pa.binary()), ("marks", pa.binary())])
_MARKED = pa.schema([("bucket", pa.int64()), ("marks", pa.binary())])
_DOCS = pa.schema([(_ID, pa.int64()), (_KEY, pa.int64()), (_STARTS, pa.list_(pa.int32())), (_SIZES, pa.list_(pa.int32()))])


def _owner(ids, keys, parts: int) -> np.ndarray:
    """Part of the documents that a row belongs to; copies of one text are spread."""
    return (W.mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * keys.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _entries(held: list, parts: int):
    """Of a run of documents (h1, h2, ids, keys, pos by slice, let go): marks it knows itself, and for each bucket the entries
    that others must judge."""
    columns = [list(x) for x in zip(*held)]
    held.clear()
    for i, column in enumerate(columns):
        columns[i] = np.concatenate(column)
        column.clear()
    order = np.lexsort((columns[2], columns[1], columns[0]))
    for i, column in enumerate(columns):
        columns[i] = column[order]
    h1, h2, ids, keys, pos = columns
    del columns, column, order
    fresh = np.ones(len(h1), dtype=bool)
    fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    known = ids > ids[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    out = [(g, None, blob) for g, blob in _blocks(_owner(ids[known], keys[known], parts), ids[known], keys[known], pos[known])]
    h1, h2, ids, keys, pos = (x[~known] for x in (h1, h2, ids, keys, pos))
    bucket = ((h2 >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    out += [(g, blob, None) for g, blob in _blocks(bucket, ids, keys, pos, h1, h2.astype(np.uint32))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(_SENT.types)], schema=_SENT)


def _judge(table: pa.Table, parts: int) -> pa.Table:
    """One bucket of windows: which entries have a smaller document elsewhere; marks of the tasks pass through."""
    done = [(r["bucket"], r["marks"]) for r in table.select(["bucket", "marks"]).to_pylist() if r["marks"] is not None]
    blobs = [x.as_py() for x in table.column("entries") if x.is_valid]
    if blobs:
        ids, keys, pos, h1, h2 = (np.concatenate(x) for x in zip(*(_opened(x, (np.uint64, np.uint32)) for x in blobs)))
        order = np.lexsort((ids, h2, h1))
        h1, h2, low = h1[order], h2[order], ids[order]
        fresh = np.ones(len(h1), dtype=bool)
        fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        late = order[low > low[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]]
        ids, keys, pos = ids[late], keys[late], pos[late]
        done += _blocks(_owner(ids, keys, parts), ids, keys, pos)
    return pa.Table.from_arrays([pa.array([r[i] for r in done], kind) for i, kind in enumerate(_MARKED.types)], schema=_MARKED)


def _gather(table: pa.Table) -> pa.Table:
    """One part of the documents: window starts of each as runs, one row a document."""
    ids, keys, pos = (np.concatenate(x) for x in zip(*(_opened(x.as_py()) for x in table.column("marks"))))
    order = np.lexsort((pos, keys, ids))
    ids, keys, pos = ids[order], keys[order], pos[order]
    doc = np.ones(len(ids), dtype=bool)
    doc[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
    run = doc.copy()
    run[1:] |= pos[1:] > pos[:-1] + 1
    heads = np.flatnonzero(run)
    tails = np.concatenate((heads[1:], [len(pos)])) - 1
    first = np.flatnonzero(doc[heads])
    edges = np.concatenate((first, [len(heads)]))
    return pa.Table.from_arrays([
        pa.array(ids[heads[first]]), pa.array(keys[heads[first]]), W.lists(pos[heads].astype(np.int32), edges, pa.int32()),
        W.lists((pos[tails] - pos[heads] + 1).astype(np.int32), edges, pa.int32()),
    ], schema=_DOCS)


def marks(docs: DataFrame, text: str, window: int, repeated, depth: int, width: int, parts: int) -> DataFrame:
    """(id, key, starts, sizes): windows that also start in a document with a smaller id, as runs; one row a document."""

    def flagged(batches):
        bits = repeated.value
        held, n = [], 0

        for batch, start, row, (h1, h2) in _hashed(batches, text, window, True):
            maybe = np.ones(len(h1), dtype=bool)
            for r in range(depth):
                at = cells(h1, r, width)
                maybe &= (bits[r][at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            ids = batch.column(batch.schema.get_field_index(_ID)).to_numpy()[row[maybe]]
            keys = batch.column(batch.schema.get_field_index(_KEY)).to_numpy()[row[maybe]]
            held.append((h1[maybe], h2[maybe], ids, keys, start[maybe]))
            n += int(maybe.sum())
            if n >= HELD // 2:
                yield _entries(held, parts)
                n = 0
        if n:
            yield _entries(held, parts)

    def judge(table: pa.Table) -> pa.Table:
        return _judge(table, parts)

    sent = docs.select(text, _ID, _KEY).mapInArrow(flagged, "bucket long, entries binary, marks binary")
    judged = sent.groupBy("bucket").applyInArrow(judge, "bucket long, marks binary")
    return judged.groupBy("bucket").applyInArrow(_gather, f"{_ID} long, {_KEY} long, {_STARTS} array<int>, {_SIZES} array<int>")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 13, depth: int = 2,
          cells_per_window: float = 2.0, sketch_bits: int = 1 << 30) -> DataFrame:
    """All rows of `docs` with repeated words removed: n_words, n_removed, kept (joined by one space), removed (word
    ranges, end exclusive).

    Words are `[^\\x20\\x09-\\x0D]+`.  A word goes if a run of `window` words over it also starts in a row with a smaller
    `doc_id`; the input decides, not what is left.  Rows with equal ids are one document in this sense, rows with a
    null id come after all others; a null text has no words and keeps null.  Columns of `docs` with an added name
    are replaced.  `depth` 1 or 2 rows of the sketch, `cells_per_window` cells a window in each, `sketch_bits` bits in all
    at most: these change the speed only.
    """
    if depth not in (1, 2):
        raise ValueError("depth must be 1 or 2")
    spark = docs.sparkSession
    docs = docs.drop(*ADDED.names)
    keyed = docs.withColumn(_ID, F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1))).withColumn(_KEY, F.xxhash64(text))
    size = docs.agg(F.sum(F.octet_length(text)), F.count(text)).first()
    guess = max(1, int(size[0] or 0) // 6)
    width = int(min(guess * cells_per_window, sketch_bits // depth, (1 << 32) - SEGMENT)) // SEGMENT * SEGMENT + SEGMENT
    bits = np.zeros((depth, width // 8), dtype=np.uint8)
    for segment, data in sketch(docs, text, window, depth, width).collect():  # sketch_bits at most
        at = segment // depth * (SEGMENT // 8)
        bits[segment % depth, at:at + SEGMENT // 8] = np.frombuffer(zstandard.decompress(bytes(data)), np.uint8)
    repeated = spark.sparkContext.broadcast(bits)
    found = marks(keyed, text, window, repeated, depth, width, max(16, guess >> 21))
    joined = keyed.join(never_broadcast(found), [_ID, _KEY], "left")  # Spark takes the runs of a document for one, and marks come packed
    names = docs.columns

    def remove(batches):
        for whole in batches:
            for batch in W.slices(whole, text):
                get = lambda c: batch.column(batch.schema.get_field_index(c))
                n_words, n_removed, kept, spans = [], [], [], []
                for x, starts, sizes in zip(get(text), get(_STARTS), get(_SIZES)):
                    words = x.as_buffer().to_pybytes().split() if x.is_valid else []
                    gone = []
                    if starts.is_valid and len(starts):
                        hit = W.covered(len(words), starts.values.to_numpy(), sizes.values.to_numpy() + (window - 1))
                        gone = np.stack(W.runs(hit), 1).tolist()
                        left = list(compress(words, (~hit).tolist()))
                    else:
                        left = words
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(left))
                    kept.append(b" ".join(left).decode() if x.is_valid else None)
                    spans.append([{"first": a, "end": b} for a, b in gone])
                added = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()),
                         pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))]
                yield pa.RecordBatch.from_arrays([*map(get, names), *added], names=[*names, *ADDED.names])

    return joined.select(*[F.col(f"`{c}`") for c in names], _STARTS, _SIZES).mapInArrow(
        remove, T.StructType(docs.schema.fields + ADDED.fields))


def clean(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The same rows and columns; texts with repeated words lose them (and keep one space between words)."""
    moved, columns = aside(docs, ADDED.names)
    new = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(f"`{text}`"))
    return dedup(moved, text=text, **options).select(*[new.alias(c) if c == text else own for c, own in columns.items()])
