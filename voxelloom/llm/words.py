"""Words of whole texts as numpy arrays: bounds, hashes and windows, without a Python string per word.

A text is its UTF-8 bytes.  All temporaries over bytes are made block by block, so memory per
text is a small multiple of its size, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that separate words: [^\x20\x09-\x0D]+ are words.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ are words (of lower-cased text).
SIGN = np.zeros(256, dtype=bool)
SIGN[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

BLOCK = 1 << 18
#: Odd multipliers of the two independent word hashes.
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each text) of an Arrow string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most `limit` bytes of text; a longer text is a run of its own."""
    _, offsets = flat(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def bounds(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte bounds of all words, and the first word of each text (one more at the end).

    A word never spans two texts.
    """
    inside = ~apart[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    after = before[1:].copy()
    after[:-1] = inside[1:]
    after[-1:] = False
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser in which every bit of the input moves every bit of the output."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(seed: int) -> tuple[np.ndarray, np.ndarray]:
    if seed not in _POWERS:
        factor = np.full(BLOCK + 1, seed, dtype=np.uint64)
        factor[0] = 1
        inverse = np.full(BLOCK + 1, pow(seed, -1, 1 << 64), dtype=np.uint64)
        inverse[0] = 1
        _POWERS[seed] = np.cumprod(factor), np.cumprod(inverse)
    return _POWERS[seed]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEEDS[0]) -> np.ndarray:
    """A 64-bit hash of each word: its bytes as a polynomial modulo 2^64, mixed."""
    power, inverse = _powers(seed)
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = int(np.searchsorted(ends, base + BLOCK, "right"))
        if to == at:  # one word longer than a block
            total, scale = 0, 1
            for i in range(base, int(ends[at]), BLOCK):
                piece = data[i:min(i + BLOCK, int(ends[at]))].astype(np.uint64) + np.uint64(1)
                total += int((piece * power[:len(piece)]).sum()) * scale
                scale = scale * int(power[BLOCK]) % (1 << 64)
            out[at] = total % (1 << 64)
            at += 1
            continue
        sums = np.zeros(int(ends[to - 1]) - base + 1, dtype=np.uint64)
        piece = data[base:int(ends[to - 1])].astype(np.uint64) + np.uint64(1)
        np.cumsum(piece * power[:len(piece)], out=sums[1:])
        s = starts[at:to] - base
        out[at:to] = (sums[ends[at:to] - base] - sums[s]) * inverse[s]
        at = to
    return mix(out)


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k word hashes (texts run on; see `whole`)."""
    n = max(len(words) - k + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[j:j + n]
    return mix(out)


def whole(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, text) of the windows of k words that lie in one text."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    return np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + first[text], text


def covered(n: int, starts: np.ndarray, lengths) -> np.ndarray:
    """Which of n words lie in any of the given runs."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of true values."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the first value of each list."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))
