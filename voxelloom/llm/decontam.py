"""Benchmark decontamination: an FM-index per training shard, searched with the phrases of the test items.

A shard is a run of documents inside one task (`shard_words` words at most, or one longer document), so the index
lives and dies in the task and nothing is shuffled.  Words that occur in no test item can be part of no phrase;
they are one end mark each in the index, and stretches shorter than the shortest phrase hold none.  Equal stretches
(copies) are indexed once with the list of places they stand at.  Phrases come in blocks of bounded size; each
block is one more pass over the documents in the same plan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.llm import words as W
from voxelloom.llm.fmindex import FMIndex
from voxelloom.llm.setup import aside

_SPAN = T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())])
#: Columns that `scan` adds.
ADDED = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.LongType())), T.StructField("word_spans", T.ArrayType(_SPAN)),
    T.StructField("char_spans", T.ArrayType(_SPAN)),
])


class Phrases:
    """Vocabulary and windows of a block of test items."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        data, offsets = W.flat(pa.array([text for _, text in items], pa.string()))
        data = W.LOWER[data]
        starts, ends, first = W.bounds(data, offsets, W.SIGN)
        hashed = W.hashes(data, starts, ends)
        self.vocabulary, symbols = np.unique(hashed, return_inverse=True)
        symbols = symbols + 1
        self.groups = []  # (patterns of one length, for each the items that hold it)
        sizes = np.diff(first)
        for length in sorted({min(int(n), window) for n in sizes if n}):
            owners: dict[bytes, set[int]] = {}
            for i in np.flatnonzero(np.minimum(sizes, window) == length):
                for at in range(first[i], first[i + 1] - length + 1):
                    owners.setdefault(symbols[at:at + length].tobytes(), set()).add(items[i][0])
            rows = np.frombuffer(b"".join(owners), symbols.dtype).reshape(-1, length)
            each = [sorted(x) for x in owners.values()]
            first_owner = np.concatenate(([0], np.cumsum([len(x) for x in each])))
            self.groups.append((rows, np.array([y for x in each for y in x], dtype=np.int64), first_owner))
        self.shortest = min((rows.shape[1] for rows, _, _ in self.groups), default=0)

    def symbols(self, hashed: np.ndarray) -> np.ndarray:
        """Symbol of each word, 0 for words of no item."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashed), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashed, at + 1, 0)


def occurrences(symbols: np.ndarray, first: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start word, length, item) of every occurrence of a phrase in a shard; `first`: first word of each document."""
    none = np.zeros(0, np.int64)
    if not phrases.groups or not len(symbols):
        return none, none, none
    known = symbols > 0
    # a stretch never spans two documents: cut at their first words
    lead = np.zeros(len(symbols), dtype=bool)
    lead[first[first < len(symbols)]] = True
    start = np.flatnonzero(known & (lead | ~np.concatenate(([False], known[:-1]))))
    stop = np.flatnonzero(known & np.concatenate((lead[1:] | ~known[1:], [True]))) + 1
    long = stop - start >= phrases.shortest
    start, stop = start[long], stop[long]
    if not len(start):
        return none, none, none
    places: dict[bytes, list[int]] = {}
    small = symbols.astype(np.int32)
    for a, b in zip(start.tolist(), stop.tolist()):
        places.setdefault(small[a:b].tobytes(), []).append(a)
    sizes = np.array([len(x) // 4 + 1 for x in places])
    base = np.cumsum(sizes) - sizes
    text = np.zeros(int(sizes.sum()), dtype=np.int64)
    filled = np.ones(len(text), dtype=bool)
    filled[base + sizes - 1] = False
    text[filled] = np.frombuffer(b"".join(places), np.int32)
    copies = np.array([len(x) for x in places.values()])
    spots = np.concatenate([np.array(x) for x in places.values()])
    first_spot = np.cumsum(copies) - copies
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    found = []
    for patterns, owners, first_owner in phrases.groups:
        low, high = index.search(patterns)
        count = high - low
        pattern = np.repeat(np.arange(len(patterns)), count)
        rows = np.arange(len(pattern)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        at = index.locate(rows)
        stretch = np.searchsorted(base, at, "right") - 1
        # every place of the stretch, then every item of the phrase
        n = copies[stretch]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        where = spots[np.repeat(first_spot[stretch], n) + nth] + np.repeat(at - base[stretch], n)
        pattern = np.repeat(pattern, n)
        m = np.diff(first_owner)[pattern]
        nth = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        item = owners[np.repeat(first_owner[pattern], m) + nth]
        found.append((np.repeat(where, m), np.full(len(item), patterns.shape[1]), item))
    return tuple(np.concatenate(x) for x in zip(*found))


def _shard(parts: list[tuple[pa.RecordBatch, int]], phrases: Phrases):
    """The rows of a shard with what was found in them joined to what earlier blocks found."""
    for batch, column in parts:
        data, offsets = W.flat(batch.column(column))
        lower = W.LOWER[data]
        starts, ends, first = W.bounds(lower, offsets, W.SIGN)
        symbols = phrases.symbols(W.hashes(lower, starts, ends)) if phrases.groups else np.zeros(len(starts), np.int64)
        yield batch, data, offsets, starts, ends, first, symbols


def _finish(shard: list, phrases: Phrases, earlier: bool):
    counts = [len(x[6]) for x in shard]
    base = np.concatenate(([0], np.cumsum(counts)))
    firsts = [x[5][:-1] + b for x, b in zip(shard, base)]
    symbols = np.concatenate([x[6] for x in shard])
    at, length, item = occurrences(symbols, np.concatenate(firsts), phrases)
    for (batch, data, offsets, starts, ends, first, own), b in zip(shard, base):
        here = (at >= b) & (at < b + len(own))
        a, n, who = at[here] - b, length[here], item[here]
        doc = np.searchsorted(first, a, "right") - 1
        pairs = [np.stack((doc, who), 1)]
        if earlier:
            old = batch.column(batch.schema.get_field_index("word_spans"))
            spans, d = old.flatten(), np.repeat(np.arange(len(old)), np.diff(old.offsets.to_numpy()))
            low, high = (spans.field(i).to_numpy() for i in (0, 1))
            a, n = np.concatenate((a, low + first[d])), np.concatenate((n, high - low))
            old = batch.column(batch.schema.get_field_index("items"))
            pairs.append(np.stack((np.repeat(np.arange(len(old)), np.diff(old.offsets.to_numpy())), old.flatten().to_numpy()), 1))
        hit = W.covered(len(own), a, n)
        pairs = np.unique(np.concatenate(pairs), axis=0)
        step = np.concatenate(([0], np.cumsum(hit)))
        edge = np.zeros(len(own) + 1, dtype=bool)
        edge[first] = True
        s = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate(([False], hit[:-1]))))
        e = np.flatnonzero(hit & (edge[1:] | ~np.concatenate((hit[1:], [False])))) + 1
        doc = np.searchsorted(first, s, "right") - 1
        part = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        lead = (data & 0xC0) != 0x80  # first bytes of code points
        chars = np.concatenate(([0], np.cumsum(lead))) if len(s) else np.zeros(len(data) + 1, np.int64)

        def spans(low, high):
            kind = pa.struct([("first", pa.int64()), ("end", pa.int64())])
            return W.lists(pa.StructArray.from_arrays([pa.array(low), pa.array(high)], fields=list(kind)), part, kind)

        zero = chars[offsets[:-1]][doc]
        added = [
            pa.array(np.diff(first)), pa.array(step[first[1:]] - step[first[:-1]]),
            W.lists(pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(batch.num_rows + 1)), pa.int64()),
            spans(s - first[doc], e - first[doc]), spans(chars[starts[s]] - zero, chars[ends[e - 1]] - zero),
        ]
        names = [x for x in batch.schema.names if not (earlier and x in ADDED.names)]
        columns = [batch.column(batch.schema.get_field_index(x)) for x in names]
        yield pa.RecordBatch.from_arrays([*columns, *added], names=[*names, *ADDED.names])


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = 13, shard_words: int = 1 << 21, block_bytes: int = 16 << 20) -> DataFrame:
    """All rows of `docs` with the words that stand in a test phrase.

    Words are maximal runs of a-z, 0-9 and non-ASCII characters after A-Z are lower-cased.  A phrase is `window`
    consecutive words of an item, or a whole shorter item.  Added columns: n_words, n_hit (words inside any
    occurrence), items (sorted ids of the items that occur), word_spans and char_spans (merged removal spans as word
    and code point ranges, end exclusive).  A column of `docs` with one of these names is replaced.

    Null or empty texts have no words and no spans; null or empty items have no phrases; an item whose id is null is
    left out; rows with equal ids are separate rows; an empty benchmark hits nothing.  Items go to the tasks in
    blocks of about `block_bytes` of text, chosen by a hash of id and text; a row that is repeated counts once, so no
    block grows with it and the broadcast stays bounded.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c in ADDED.names])
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull())
    items = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("t")).dropDuplicates(["id", "t"])
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_bytes))
    out = docs
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == block).collect()
        phrases = spark.sparkContext.broadcast(Phrases([(r.id, r.t) for r in rows], window))
        earlier = block > 0
        keep = out.drop(*ADDED.names)

        def run(batches, phrases=phrases, earlier=earlier):
            shard, words = [], 0
            for whole in batches:
                column = whole.schema.get_field_index(text)
                for x in _shard([(b, column) for b in W.slices(whole, text)], phrases.value):
                    if shard and words + len(x[6]) > shard_words:
                        yield from _finish(shard, phrases.value, earlier)
                        shard, words = [], 0
                    shard.append(x)
                    words += len(x[6])
            if shard:
                yield from _finish(shard, phrases.value, earlier)

        out = out.mapInArrow(run, T.StructType(keep.schema.fields + ADDED.fields))
    return out


def contaminated(share: int = 20):
    """The rule of a contaminated document: hit at all, and one word in `share` or more."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, share: int = 20, **options) -> DataFrame:
    """The documents that are not contaminated, unchanged, with their own columns."""
    moved, columns = aside(docs, ADDED.names)
    return scan(moved, benchmark, **options).where(~contaminated(share)).select(*columns.values())


def cut(scanned: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `scan` with the removal spans taken out of the text."""
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("char_spans")),
        lambda i: F.substring(
            F.col(text),
            (F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("char_spans"), i - 1)["end"]) + 1).cast("int"),
            F.when(i == F.size("char_spans"), F.length(text)).otherwise(F.get(F.col("char_spans"), i)["first"]).cast("int")
            - F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("char_spans"), i - 1)["end"]).cast("int"),
        ),
    )
    return scanned.withColumn(text, F.when(F.size("char_spans") > 0, F.array_join(pieces, "")).otherwise(F.col(text)))
