"""License scans: winnowed fingerprints of templates pick candidates, banded alignment confirms and measures them.

Words are those of `words.SIGN` (lower-cased letters, digits, non-ASCII).  Of every `grams` consecutive word hashes the smallest
of each `window` neighbours is a fingerprint, of templates and texts alike, so any `grams` + `window` - 1 equal words in a row
share one.  The inverted index of the templates' fingerprints is small (its size is checked) and goes to every task; a text is
scanned where it is read and nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.llm import words as W

# Wording of public licenses and of common one-line statements.
TEMPLATES = {
    "Apache-2.0 statement": "Licensed under the Apache License, Version 2.0.",
    "MIT statement": "Released under the MIT License.",
    "GPL-3.0 statement": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0 statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "Apache-2.0 notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
        "express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."),
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."),
}

MATCH = T.StructType([
    T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("matched", T.LongType()),
    T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("char_start", T.LongType()), T.StructField("char_end", T.LongType()),
])
#: Words of all templates at most; the index is about 40 bytes a word.
TEMPLATE_WORDS = 1 << 20


def winnow(hashed: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of every `window` neighbours (the last one of equals); all minima of a shorter list."""
    if not len(hashed):
        return np.zeros(0, np.int64)
    window = min(window, len(hashed))
    seen = np.lib.stride_tricks.sliding_window_view(hashed[::-1], window)
    best = np.arange(len(seen)) + seen.argmin(axis=1)  # of the reversed list: the first is the last
    return np.unique(len(hashed) - 1 - best)


class Layer:
    """Fingerprints of the templates that share one length of grams and one window: fingerprint -> (template, position)."""

    def __init__(self, grams: int, window: int):
        self.grams, self.window, self.rows = grams, window, []

    def add(self, template: int, words: list[int]) -> None:
        keys = W.windows(np.array(words, dtype=np.uint64), self.grams)
        self.rows += [(int(keys[p]), template, int(p)) for p in winnow(keys, self.window)]

    def close(self) -> None:
        self.rows.sort()
        self.keys = np.array([r[0] for r in self.rows], dtype=np.uint64)
        self.places = [(t, p) for _, t, p in self.rows]

    def hits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in keys, first, end of its postings)."""
        a, b = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        at = np.flatnonzero(b > a)
        return at, a[at], b[at]


def equal_run(length: int, least: float) -> int:
    """Words in a row that a place of a template keeps at least, if other words stand in for the rest."""
    kept = int(np.ceil(least * length - 1e-9))
    return max(1, -(-kept // (length - kept + 1)))


class Index:
    """Word hashes of the templates, and their fingerprints in layers.

    A template's grams and window follow from its length and the least coverage: winnowing finds every run of
    grams + window - 1 equal words, and every place in which words are replaced keeps a run of that length.
    """

    def __init__(self, templates: dict[str, str], grams: int, window: int, least: float = 0.8):
        self.names = sorted(templates)
        data, offsets = W.flat(pa.array([templates[n] for n in self.names], pa.string()))
        data = W.LOWER[data]
        starts, ends, first = W.bounds(data, offsets, W.SIGN)
        if len(starts) > TEMPLATE_WORDS:
            raise ValueError("the templates are too large to send to every task")
        hashed = W.hashes(data, starts, ends)
        self.words = [hashed[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
        layers: dict[tuple[int, int], Layer] = {}
        for t, words in enumerate(self.words):
            if words:
                run = equal_run(len(words), least)
                shape = min(grams, run), min(window, run - min(grams, run) + 1)
                layers.setdefault(shape, Layer(*shape)).add(t, words)
        self.layers = [layers[shape] for shape in sorted(layers)]
        for layer in self.layers:
            layer.close()


def align(template: list[int], words: list[int], low: int, high: int) -> tuple[int, int, int]:
    """(matched, first, end): best local alignment with diagonals (text minus template) from `low` to `high`.

    A match counts 2, a mismatch or gap -1; of equal scores the one with more matches, then the earlier one.
    """
    best = (0, 0, 0, 0)
    none = (0, 0, 0)
    before: dict[int, tuple[int, int, int]] = {}
    for i, t in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(i + low, 0), min(i + high + 1, len(words))):
            score, matched, start = before.get(j - 1, none)
            if score <= 0:
                score, matched, start = 0, 0, -j
            cell = (score + 2, matched + 1, start) if words[j] == t else (score - 1, matched, start)
            for other in (before.get(j, none), row.get(j - 1, none)):
                if other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, other[1], other[2])
            if cell[0] > 0:
                row[j] = cell
                if (cell[0], cell[1]) > best[:2]:
                    best = (cell[0], cell[1], -cell[2], j + 1)
        before = row
    return best[1:]


def places(target: list[int], words: np.ndarray, low: int, high: int, least: float) -> list[tuple[int, int, int]]:
    """(matched, first, end) of all places with diagonals from `low` to `high`: the best one, then left and right of it."""
    out = []
    need = least * len(target)
    parts = [(max(low, 0), min(max(high + len(target), 0), len(words)))]
    while parts:
        start, stop = parts.pop()
        if stop - start < need:
            continue
        matched, first, end = align(target, words[start:stop].tolist(), low - start, high - start)
        if matched >= need:
            out.append((matched, first + start, end + start))
        if end > first and 2 * matched >= need:
            parts += [(start, first + start), (end + start, stop)]
    return out


def find(words: np.ndarray, index: Index, band: int, least: float) -> list[tuple[int, int, int, int]]:
    """(template, matched, first, end) in one text's word hashes, by place."""
    found: dict[int, set[int]] = {}
    for layer in index.layers:
        keys = W.windows(words, layer.grams)
        picked = winnow(keys, layer.window)
        at, a, b = layer.hits(keys[picked])
        for p, i, j in zip(picked[at].tolist(), a.tolist(), b.tolist()):
            for template, q in layer.places[i:j]:
                found.setdefault(template, set()).add(p - q)
    out = []
    for template, hits in found.items():
        target = index.words[template]
        # an alignment has fewer gaps and mismatches than twice its matches
        far = 2 * len(target)
        diagonals = np.array(sorted(hits))
        best = []
        # hits whose diagonals are within the band of their neighbours are one group, aligned in runs of bounded spread
        for group in np.split(diagonals, np.flatnonzero(np.diff(diagonals) > band) + 1):
            low, high = int(group[0]) - band, int(group[-1]) + band
            i = 0
            while i < len(group):
                j = int(np.searchsorted(group, group[i] + far, "right"))
                best += places(target, words, max(low, int(group[i]) - far - band), min(high, int(group[j - 1]) + far + band), least)
                i = j
        best = sorted(set(best), key=lambda x: (-x[0], x[2] - x[1], x[1]))
        kept: list[tuple[int, int, int]] = []
        taken = np.zeros(len(words), dtype=bool)
        for matched, first, end in best:  # of overlapping places of one template the best
            if not taken[first:end].any():
                taken[first:end] = True
                kept.append((matched, first, end))
        out += [(template, *x) for x in kept]
    return sorted(out, key=lambda x: (x[2], x[3], x[0]))


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, grams: int = 3, window: int = 3,
         band: int = 8, least: float = 0.8) -> DataFrame:
    """All rows of `docs` with `licenses`: array of (license, coverage, matched, first, end, char_start, char_end).

    coverage: share of the template's words that the alignment matches, `least` or more; first and end are words, char_* code
    points of the text, ends exclusive.  Equal or overlapping templates are all reported; of overlapping places of one
    template the best.  A place is a candidate if it shares a run of words with the template that every place keeps in which
    words are replaced (four words, fewer for templates of less than eight; `grams` and `window` bound the fingerprints); words
    put in between all runs can hide a place.  Null, empty and unrelated texts have an empty list; a template without words is never found; a
    column named `licenses` is replaced.  Whole texts are scanned; `band` is how far words may shift between fingerprints.
    """
    spark = docs.sparkSession
    kept = docs.drop("licenses")
    names = kept.columns
    shared = spark.sparkContext.broadcast(Index({n: t for n, t in (TEMPLATES if templates is None else templates).items() if t}, grams, window, least))

    def run(batches):
        index = shared.value
        for whole in batches:
            for batch in W.slices(whole, text):
                data, offsets = W.flat(batch.column(batch.schema.get_field_index(text)))
                lower = W.LOWER[data]
                starts, ends, first = W.bounds(lower, offsets, W.SIGN)
                hashed = W.hashes(lower, starts, ends)
                known = np.zeros(batch.num_rows, dtype=bool)
                for layer in index.layers:  # most texts share no fingerprint at all
                    near = np.minimum(np.searchsorted(layer.keys, keys := W.windows(hashed, layer.grams)), len(layer.keys) - 1)
                    hit = np.flatnonzero(layer.keys[near] == keys)
                    known[np.searchsorted(first, hit, "right") - 1] = True
                out = []
                for i in range(batch.num_rows):
                    rows = []
                    if known[i]:
                        a, b = int(first[i]), int(first[i + 1])
                        lead = None
                        for t, matched, x, y in find(hashed[a:b], index, band, least):
                            if lead is None:
                                lead = np.concatenate(([0], np.cumsum((data[offsets[i]:offsets[i + 1]] & 0xC0) != 0x80)))
                            rows.append({"license": index.names[t], "coverage": matched / len(index.words[t]), "matched": matched, "first": x, "end": y,
                                         "char_start": int(lead[starts[a + x] - offsets[i]]), "char_end": int(lead[ends[a + y - 1] - offsets[i]])})
                    out.append(rows)
                kind = pa.list_(pa.struct([(f.name, {"string": pa.string(), "double": pa.float64()}.get(f.dataType.typeName(), pa.int64())) for f in MATCH.fields]))
                columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out, kind)], names=[*names, "licenses"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("licenses", T.ArrayType(MATCH))]))


def found(docs: DataFrame, **options) -> DataFrame:
    """One row for each license found (a document without one has none), with the columns of `docs` but the text and those named like a field of a match."""
    text = options.get("text", "text")
    return scan(docs.drop("m", *MATCH.names), **options).drop(text).withColumn("m", F.explode("licenses")).select("*", "m.*").drop("m", "licenses")
