"""Token-id output: whole texts encoded, concatenated in id order and written as Arrow files of equal-length sequences.

Each file (Arrow IPC file format) holds record batches of a fixed number of rows; a row is one sequence: `input_ids`
(fixed-size list of the smallest unsigned type that holds the vocabulary), `mask` (false on padding of the last row) and
`ends` (true on the last id of a document), plus `docs`, the ids of the documents that end in the row.  All batches but
the last have the same shape, so row i is in batch i // rows at i % rows and is read without a copy from a mapped file.
"""

from __future__ import annotations

import os
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.llm import words as W
from voxelloom.llm.setup import stored
from voxelloom.session import scratch_path
from voxelloom.sources.files import open_fs

MANIFEST = "part int, path string, n_docs long, n_tokens long, n_rows long"
#: Stands between pieces: white space, so the pre-tokenizer sets it apart.
_MARK = "\x0b"
#: First bytes of characters that are or may be white space.
_MAYBE_WHITE = np.zeros(256, dtype=bool)
_MAYBE_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_ENCODERS: dict[tuple[str, int], Encoder] = {}


class Encoder:
    """A byte-level BPE tokenizer with a bounded memory of the pieces it has met.

    The pre-tokenizer of such a file always starts a new token at a blank that is followed by anything but white space,
    so a text may be cut there and equal pieces have equal ids.  Texts that hold a special token are encoded whole.
    New pieces go through the tokenizer many at once; a piece is found again by its hash.
    """

    def __init__(self, path: str, end: int, memory: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.uint16 if max(self.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else np.uint32
        self.end = np.array([end], self.kind)
        self.memory = memory
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.kind)

    def one(self, text: str) -> np.ndarray:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return np.array(encode([text], add_special_tokens=False)[0].ids, self.kind)

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces go to the pool: (place, number) of each.

        Most are encoded at once, with a mark between that is a token of its own after anything but white space.
        """
        at, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        added, base = [self.pool], len(self.pool)
        plain = np.fromiter((_MARK not in p and not p[-1].isspace() for p in pieces), bool, len(pieces))
        todo = np.flatnonzero(~plain).tolist()
        for some in np.array_split(np.flatnonzero(plain), plain.sum() // 4096 + 1):
            ids = self.one(_MARK.join([pieces[i] for i in some.tolist()])) if self.mark is not None else np.zeros(0, self.kind)
            cuts = np.flatnonzero(ids == self.mark)
            if len(some) and len(cuts) == len(some) - 1:
                edges = np.concatenate(([-1], cuts, [len(ids)]))
                at[some], size[some] = base + edges[:-1] + 1, np.diff(edges) - 1
                added.append(ids)
                base += len(ids)
            else:
                todo += some.tolist()
        for i in todo:
            ids = self.one(pieces[i])
            at[i], size[i] = base, len(ids)
            added.append(ids)
            base += len(ids)
        self.pool = np.concatenate(added)
        return at, size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each text and the end) of texts given as bytes and offsets; no end ids."""
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(offsets), np.int64)
        start = np.zeros(len(data), dtype=bool)
        start[:-1] = (data[:-1] == 0x20) & ~_MAYBE_WHITE[data[1:]]
        last = offsets[1:-1] - 1
        start[last[last >= 0]] = False  # the blank that ends a text
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(data))
        hashed, which = np.unique(W.hashes(data, starts, ends), return_inverse=True)
        first = np.empty(len(hashed), np.int64)
        first[which] = np.arange(len(which))  # any place of each piece
        if len(self.keys) > self.memory:
            self._forget()
        place = np.minimum(np.searchsorted(self.keys, hashed), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[place] != hashed) if len(self.keys) else np.arange(len(hashed))
        if len(new):
            raw = data.tobytes()
            at, size = self._learn([raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            keys = np.concatenate((self.keys, hashed[new]))
            order = np.argsort(keys, kind="stable")
            self.keys, self.at, self.size = keys[order], np.concatenate((self.at, at))[order], np.concatenate((self.size, size))[order]
            place = np.searchsorted(self.keys, hashed)
        place = place[which]
        size = self.size[place]
        total = np.concatenate(([0], np.cumsum(size)))
        found = self.pool[np.repeat(self.at[place] - total[:-1], size) + np.arange(total[-1])]
        return found, total[np.searchsorted(starts, offsets)]

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of each whole text with the end id."""
        raw = data.tobytes()
        whole = any(s in raw for s in self.special)
        ids, first = self.encode(data, offsets)
        for i in range(len(offsets) - 1):
            if whole and any(s in (text := raw[offsets[i]:offsets[i + 1]]) for s in self.special):
                yield np.concatenate((self.one(text.decode()), self.end))
            else:
                yield np.concatenate((ids[first[i]:first[i + 1]], self.end))


def encoder(path: str, end: int) -> Encoder:
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = Encoder(path, end)
    return _ENCODERS[path, end]


class Writer:
    """Writes documents as rows of `length` ids, `rows` rows a batch; holds one batch."""

    def __init__(self, path: str, length: int, rows: int, kind):
        fs, inner = open_fs(path)
        fs.create_dir(posixpath.dirname(inner), recursive=True)
        self.length, self.rows, self.kind = length, rows, kind
        ids, flag = pa.list_(pa.from_numpy_dtype(kind), length), pa.list_(pa.bool_(), length)
        self.schema = pa.schema([("input_ids", ids), ("mask", flag), ("ends", flag), ("docs", pa.list_(pa.int64()))])
        self.sink = fs.open_output_stream(inner)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.size, self.tokens, self.docs, self.written = 0, 0, 0, 0
        self.finished: list[tuple[int, int | None]] = []  # (place of the last id, document)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        self.tokens += len(ids)
        self.docs += 1
        self.finished.append((self.size - 1, doc))
        if self.size >= self.length * self.rows:
            self._flush(self.size // (self.length * self.rows) * self.rows)

    def _flush(self, rows: int) -> None:
        values = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        took = min(rows * self.length, len(values))
        block = np.zeros(rows * self.length, self.kind)
        block[:took] = values[:took]
        inside = [f for f in self.finished if f[0] < took]
        ends = np.zeros(len(block), dtype=bool)
        ends[[p for p, _ in inside]] = True
        first = np.searchsorted([p // self.length for p, _ in inside], np.arange(rows + 1))
        batch = pa.RecordBatch.from_arrays([
            pa.FixedSizeListArray.from_arrays(pa.array(block), type=self.schema.types[0]),
            pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(block)) < took), type=self.schema.types[1]),
            pa.FixedSizeListArray.from_arrays(pa.array(ends), type=self.schema.types[2]),
            pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array([d for _, d in inside], pa.int64())),
        ], schema=self.schema)
        for at in range(0, rows, self.rows):
            self.file.write_batch(batch.slice(at, self.rows))
        self.written += rows
        self.held = [values[took:].copy()]
        self.size -= took
        self.finished = [(p - took, d) for p, d in self.finished[len(inside):]]

    def close(self) -> None:
        if self.size:
            self._flush(-(-self.size // self.length))
        self.file.close()
        self.sink.close()


def write(docs: DataFrame, folder: str, tokenizer: str, end: int, doc_id: str = "doc_id", text: str = "text",
          length: int = 2048, rows: int = 64, file_bytes: int = 16 << 20) -> DataFrame:
    """Write all documents in ascending id order; the manifest, one row a file, with `start` = ids in earlier files.

    Null texts are empty: the end id alone.  Null ids come first; equal ids are ordered by a hash of the text.  Files hold
    about `file_bytes` of text each.  A file has a name of its own for every attempt; only files in the manifest count.
    """
    rows_in = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows_in.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keyed = rows_in.withColumn("key", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())  # repeated rows spread, too
    order = ["doc_id", "key", "row"]
    ranged = keyed.repartitionByRange(max(1, -(-int(size) // file_bytes)), *order).sortWithinPartitions(*order)

    def encode(batches):
        known = encoder(tokenizer, end)
        part = TaskContext.get().partitionId()
        path = f"{folder}/{part:06d}-{uuid.uuid4().hex}.arrow"
        writer = None
        for whole in batches:
            for batch in W.slices(whole, "text", 4 << 20):
                writer = writer or Writer(path, length, rows, known.kind)
                for doc, ids in zip(batch.column(0).to_pylist(), known.texts(*W.flat(batch.column(1)))):
                    writer.add(doc, ids)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [writer.docs], "n_tokens": [writer.tokens],
                                              "n_rows": [writer.written]}, pa.schema([("part", pa.int32()), ("path", pa.string()),
                                                                                      ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_rows", pa.int64())]))

    files = stored(ranged.mapInArrow(encode, MANIFEST), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def opened(path: str) -> pa.ipc.RecordBatchFileReader:
    """Random access to a file; mapped without a copy where the file system is local."""
    fs, inner = open_fs(path)
    return pa.ipc.open_file(pa.memory_map(inner) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(inner))


def sequence(reader: pa.ipc.RecordBatchFileReader, row: int, rows: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of one sequence; the ids are a view of the file."""
    batch = reader.get_batch(row // rows)
    column = batch.column(0)
    ids = column.values.to_numpy()[(column.offset + row % rows) * column.type.list_size:][:column.type.list_size]
    return ids, np.array(batch.column(1)[row % rows].as_py())


def documents(reader: pa.ipc.RecordBatchFileReader) -> Iterator[tuple[int | None, int, int]]:
    """(document, number of ids, crc32 of the ids as little-endian 32-bit numbers) in file order, a batch at a time."""
    size = crc = 0
    for i in range(reader.num_record_batches):
        batch = reader.get_batch(i)
        ids = batch.column(0).flatten().to_numpy()
        valid = int(batch.column(1).flatten().true_count)
        ends = np.flatnonzero(batch.column(2).flatten().to_numpy(zero_copy_only=False)) + 1
        wide = ids[:valid].astype("<u4")
        at = 0
        for stop, doc in zip(ends.tolist(), batch.column(3).flatten().to_pylist()):
            yield doc, size + stop - at, zlib.crc32(wide[at:stop], crc)
            at, size, crc = stop, 0, 0
        size += valid - at
        crc = zlib.crc32(wide[at:], crc)


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def digest(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(documents(opened(path)))
                doc, n, crc = zip(*found)
                at = start + np.concatenate(([0], np.cumsum(n)[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], schema=kind)

    files = manifest.select("path", "start")
    return files.repartition(max(1, min(files.count(), 10_000))).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def folder(docs: DataFrame) -> str:
    """A fresh folder in the shared place."""
    return scratch_path(docs.sparkSession, "tokens")
