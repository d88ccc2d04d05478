"""Phrase collocations: count transducers per shard, their union by prefix range, and part lookups by composition.

1. Texts are cut into pieces and words; a shard is about a million words of whole pieces with its own word list (written).
2. Words are counted.  A phrase that occurs often has only words that do; those get numbers, and every shard its part of them.
3. A shard's phrases are sorted and become a minimal count transducer for each range of phrases.  Ranges are cut anywhere in the
   order of phrases, at quantiles of a sample, so a word or a pair that starts a third of all phrases fills many ranges.
4. A range's transducers are united, weights summed, and what occurs too seldom is dropped, but for the prefixes that go on in
   another range; their counts are summed over the ranges.
5. The parts of every candidate are looked up where they lie: the parts asked of a range are an acceptor, composed with the
   range's transducer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.llm import automata as A
from voxelloom.llm import words as W
from voxelloom.llm.setup import ready, stored
from voxelloom.llm.shard import number
from voxelloom.operators.blocks import never_broadcast

#: Bytes at which a piece ends: [.,;:!?\x0A-\x0D]; blanks between words of a piece: [\x20\x09].
STOP = np.zeros(256, dtype=bool)
STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
APART = STOP.copy()
APART[[0x20, 0x09]] = True

UNKNOWN = "und"
#: Words of a shard, and positions of a range, about.
SHARD_WORDS, RANGE_WORDS = 1 << 20, 1 << 21
#: Shards that give a sample of their phrases, one in STRIDE, or more so that a range has PER_RANGE of them: range bounds come from at
#: most about SAMPLED * SHARD_WORDS / STRIDE phrases, or PER_RANGE a range.
SAMPLED, STRIDE, PER_RANGE = 64, 4096, 64
#: How shards and transducers are written: a group of rows ends at 16 MB, looked at row by row, as a row has megabytes.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
#: Parts in which the phrases of a language are ranked before they meet.
PARTS = 32


class Shard:
    """Words of whole pieces, until there are enough."""

    def __init__(self):
        self.words, self.langs, self.fresh, self.size = [], [], [], 0
        self.names: dict[str, int] = {}

    def add(self, words: pa.Array, langs: np.ndarray, fresh: np.ndarray) -> None:
        self.words.append(words)
        self.langs.append(langs)
        self.fresh.append(fresh)
        self.size += len(words)

    def row(self, name: int) -> pa.RecordBatch:
        """(shard, its words by language with counts, its pieces as places in that list from 1, 0 between pieces)."""
        coded = pa.concat_arrays(self.words).dictionary_encode()
        many = max(1, len(coded.dictionary))
        key, place, count = np.unique(np.concatenate(self.langs) * many + coded.indices.to_numpy(), return_inverse=True, return_counts=True)
        fresh = np.concatenate(self.fresh)
        tokens = np.zeros(len(place) + int(fresh.sum()), dtype=np.int32)
        tokens[np.arange(len(place)) + np.cumsum(fresh)] = place + 1
        names = pa.array(list(self.names), pa.string())
        listed = pa.StructArray.from_arrays([names.take(pa.array(key // many)), coded.dictionary.take(pa.array(key % many)).cast(pa.string()), pa.array(count, pa.int64())],
                                            names=["lang", "word", "n"])
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), listed),
                                           pa.array([tokens.tobytes()], pa.binary())], names=["shard", "words", "tokens"])


def shards(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(shard, words array<struct<lang, word, n>>, tokens): all texts as lists of numbered words."""
    used = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard = TaskContext.get().partitionId() << 32, Shard()
        for whole in batches:
            for batch in W.slices(whole, "text"):
                data, offsets = W.flat(batch.column(0))
                data = W.LOWER[data]
                begin, end, first = W.bounds(data, offsets, APART)
                if not len(begin):
                    continue
                sizes = np.concatenate(([0], np.cumsum(end - begin)))
                letters = data[~APART[data]]
                stops = np.cumsum(STOP[data])
                fresh = A.starts(stops[begin])
                fresh[first[:-1][first[:-1] < len(begin)]] = True
                codes = np.array([shard.names.setdefault(x, len(shard.names)) for x in batch.column(1).to_pylist()])
                langs = np.repeat(codes, np.diff(first))
                pieces = np.append(np.flatnonzero(fresh), len(begin))
                at = 0
                while at < len(begin):  # whole pieces, as many as the shard still takes
                    to = int(pieces[min(np.searchsorted(pieces, at + SHARD_WORDS - shard.size), len(pieces) - 1)])
                    base = sizes[at]
                    part = pa.LargeStringArray.from_buffers(to - at, pa.py_buffer((sizes[at:to + 1] - base).astype(np.int64)), pa.py_buffer(letters[base:sizes[to]]))
                    shard.add(part, langs[at:to], fresh[at:to])
                    at = to
                    if shard.size >= SHARD_WORDS:
                        yield shard.row(name)
                        kept, shard, name = shard.names, Shard(), name + 1
                        shard.names = kept
        if shard.size:
            yield shard.row(name)

    return used.mapInArrow(run, "shard long, words array<struct<lang: string, word: string, n: long>>, tokens binary")


def grams(tokens: np.ndarray, numbers: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrases, counts): what starts at each position, up to `longest` words of a piece with a number, sorted and counted."""
    ids = np.append(numbers[tokens], np.zeros(longest, np.int64))
    at = np.flatnonzero(ids)
    columns, more = [], np.ones(len(at), dtype=bool)
    for j in range(longest):
        more &= ids[at + j] > 0
        columns.append(np.where(more, ids[at + j], 0))
    rank = columns[0]
    for column in columns[1:-1]:
        _, rank = np.unique(rank << 32 | column, return_inverse=True)
    key, index, counts = np.unique(rank << 32 | columns[-1] if longest > 1 else rank, return_index=True, return_counts=True)
    return np.column_stack([c[index] for c in columns]), counts.astype(np.int64)


def keys(phrases: np.ndarray) -> np.ndarray:
    """Phrases as strings of bytes in the same order."""
    wide = np.ascontiguousarray(phrases.astype(">u4"))
    return wide.view(f"S{4 * wide.shape[1]}").ravel() if len(wide) else np.zeros(0, f"S{4 * phrases.shape[1]}")


def numbered(tokens: DataFrame, words: DataFrame, count: int, work, schema: str) -> DataFrame:
    """`work(tokens, numbers)` -> record batch, for every shard with its words' numbers."""
    listed = tokens.select("shard", F.posexplode("words").alias("at", "w")).select("shard", "at", "w.lang", "w.word")
    own = listed.join(never_broadcast(words.select("lang", "word", "id")), ["lang", "word"]).select(F.col("shard").alias("home"), "at", "id")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([work(np.zeros(0, np.int32), np.zeros(1, np.int64))])
        at, size = right.column("at").to_numpy(), left.column("size")[0].as_py()
        table = np.zeros(size + 1, dtype=np.int64)
        table[at + 1] = right.column("id").to_numpy()
        return pa.Table.from_batches([work(np.frombuffer(left.column("tokens")[0].as_py(), np.int32), table)])

    held = tokens.select("shard", "tokens", F.size("words").alias("size")).repartition(max(1, count), "shard")
    return held.groupBy("shard").cogroup(own.groupBy("home")).applyInArrow(run, schema)


def lists(rows: np.ndarray) -> pa.Array:
    """Rows of whole numbers as an Arrow list column, without the zeros at their ends."""
    real = rows > 0
    return W.lists(rows[real], np.concatenate(([0], np.cumsum(real.sum(1)))), pa.int64())


def padded(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """An Arrow list column as rows of `width` numbers."""
    held = column.combine_chunks()
    sizes = held.value_lengths().to_numpy()
    out = np.zeros((len(held), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = held.flatten().to_numpy()
    return out


def sample_stride(ranges: int, amount: int) -> int:
    """One position in how many is drawn, so that each of `ranges` has about PER_RANGE from the shards that are sampled, of `amount`."""
    return max(1, min(STRIDE, min(amount, SAMPLED) * SHARD_WORDS // (PER_RANGE * max(1, ranges))))


def drawn_at(size: int, stride: int, seed: int) -> np.ndarray:
    """A position of each run of `stride`, anywhere in it: were it the same place in all shards, shards that are alike would draw the
    same phrases, and no range could be shorter than a run.
    """
    at = np.arange(0, size, stride)
    at += np.random.default_rng(seed).integers(0, stride, len(at))
    return at[at < size]


def count(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4,
          range_words: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, np.ndarray]:
    """(words, totals, transducers, bounds): numbered words, all words of a language, and the count transducer of every range."""
    ready(docs.sparkSession)
    cut = stored(shards(docs, text, lang), "shards", **LARGE_ROWS)
    listed = cut.select(F.explode("words").alias("w")).groupBy("w.lang", "w.word").agg(F.sum("w.n").alias("n"))
    listed = stored(listed, "words")
    totals = listed.groupBy("lang").agg(F.sum("n").alias("n"))
    often = listed.where(F.col("n") >= least).select(F.lit(0).alias("shard"), "lang", "word", "n", (-F.col("n")).alias("low"))
    words = stored(number(often, ["low", "lang", "word"]).select("lang", "word", "n", (F.col("slot") + 1).alias("id")), "numbers")
    if words.count() >= 1 << 31:
        raise ValueError("more than 2^31 frequent words")
    amount = cut.count()
    ranges = -(-int(totals.agg(F.sum("n")).first()[0] or 0) // (range_words or RANGE_WORDS))

    stride = sample_stride(ranges, amount)

    def sample(tokens: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
        rows, counts = grams(tokens, numbers, longest)
        at = np.searchsorted(np.cumsum(counts), drawn_at(int(counts.sum()), stride, zlib.crc32(tokens)), "right")
        return pa.RecordBatch.from_arrays([lists(rows[at])], names=["phrase"])

    bounds = np.zeros((0, longest), dtype=np.int64)
    if ranges > 1:
        some = cut.where(F.pmod(F.xxhash64("shard"), F.lit(amount)) < SAMPLED)
        drawn = numbered(some, words, min(amount, SAMPLED), sample, "phrase array<long>").toArrow()
        rows = padded(drawn.column("phrase"), longest)
        rows = rows[np.argsort(keys(rows), kind="stable")]
        if len(rows):
            bounds = np.unique(rows[np.arange(1, ranges) * len(rows) // ranges], axis=0)
    cuts = keys(bounds)

    def blocks(tokens: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
        rows, counts = grams(tokens, numbers, longest)
        edges = [0, *np.searchsorted(keys(rows), cuts).tolist(), len(rows)]
        out = [(i, A.build(A.levels(rows[a:b], counts[a:b])[0]).dumps()) for i, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
        names, data = zip(*out) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(data, pa.binary())], names=["range", "block"])

    def unite(table: pa.Table) -> pa.Table:
        which = table.column("range")[0].as_py()
        spared = [bounds[i] for i in (which - 1, which) if 0 <= i < len(bounds)]
        tree = A.union((A.loads(x.as_py()) for x in table.column("block")), longest, least, spared)
        return pa.table({"range": pa.array([which], pa.int32()), "block": pa.array([A.build(tree).dumps()], pa.binary())})

    parts = numbered(cut, words, -(-amount // 2), blocks, "range int, block binary").repartition(len(bounds) + 1, "range")
    transducers = stored(parts.groupBy("range").applyInArrow(unite, "range int, block binary"), "transducers", **LARGE_ROWS)
    return words, totals, transducers, bounds


def lookup(asked: DataFrame, transducers: DataFrame, bounds: np.ndarray, longest: int) -> DataFrame:
    """(phrase, f) of every distinct phrase asked for; a phrase that goes on over several ranges is summed over them."""
    cuts = keys(bounds)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = padded(pa.chunked_array([batch.column(0)]), longest)
            low = np.searchsorted(cuts, keys(rows), "right")
            high = np.searchsorted(cuts, keys(np.where(rows > 0, rows, 0xFFFFFFFF)), "right")
            n = high - low + 1
            at = np.repeat(np.arange(len(rows)), n)
            which = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + low[at]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(which, pa.int32())], names=["phrase", "range"])

    def compose(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = padded(left.column("phrase"), longest)
        rows = rows[np.argsort(keys(rows), kind="stable")]
        found = [A.compose(rows, A.loads(x.as_py())) for x in right.column("block")]
        return pa.table({"phrase": lists(rows), "f": pa.array(sum(found, np.zeros(len(rows), np.int64)), pa.int64())})

    placed = asked.select("phrase").distinct().mapInArrow(place, "phrase array<long>, range int").repartition(len(bounds) + 1, "range")
    found = placed.groupBy("range").cogroup(transducers.groupBy("range")).applyInArrow(compose, "phrase array<long>, f long")
    return found.groupBy("phrase").agg(F.sum("f").alias("f"))


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4, scale: int = 2_000_000,
         cover: int = 80, range_words: int | None = None) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score): phrases of 2 to `longest` words that occur `least` times or more in a language.

    Texts are lower-cased (A-Z); phrases lie in pieces between [.,;:!?\\x0A-\\x0D]; words are `[^\\x20\\x09]+`.  a: occurrences,
    overlapping ones too; l and r: those of the two parts at the cut with the smallest score floor(scale * a / (l + r)), the
    earliest of such cuts; n: all words of the language.  A phrase inside a longer candidate with at least `cover` percent of its
    occurrences is left out.  A null text is empty, a null language `und`; repeated rows count each time; other columns are
    ignored.  Arithmetic is whole and in 38 digits.
    """
    words, totals, transducers, bounds = count(docs, text, lang, least, longest, range_words)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                for rows, weight in A.phrases(A.union([A.loads(block.as_py())], longest)):
                    for at in range(0, len(rows), 1 << 16):
                        yield pa.RecordBatch.from_arrays([lists(rows[at:at + (1 << 16)]), pa.array(weight[at:at + (1 << 16)], pa.int64())], names=["phrase", "a"])

    found = transducers.select("block").mapInArrow(spell, "phrase array<long>, a long").where(F.size("phrase") > 1)
    found = stored(found.groupBy("phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least), "candidates")
    cut = found.select("phrase", "a", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cut = cut.select("phrase", "a", "k", F.slice("phrase", 1, F.col("k")).alias("head"), F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k")).alias("tail"))
    asked = cut.select(F.explode(F.array("head", "tail")).alias("phrase"))
    known = stored(lookup(asked, transducers, bounds, longest), "parts")
    heads, tails = (never_broadcast(known.select(F.col("phrase").alias(part), F.col("f").alias(f))) for part, f in (("head", "l"), ("tail", "r")))
    met = cut.join(heads, "head").join(tails, "tail")
    wide = "decimal(19,0)"
    score = F.expr(f"(cast({scale} as decimal(18,0)) * cast(a as {wide})) div (cast(l as {wide}) + cast(r as {wide}))")
    least_cut = met.groupBy("phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select("phrase", "a", "cut.*").drop("k")

    inner = F.expr("flatten(transform(sequence(2, size(phrase) - 1), n -> transform(sequence(1, size(phrase) - n + 1), i -> slice(phrase, i, n))))")
    longer = found.where(F.size("phrase") > 2).select(F.explode(inner).alias("phrase"), F.col("a").alias("b")).groupBy("phrase").agg(F.max("b").alias("b"))
    held = F.col("b").isNotNull() & (F.col("b").cast(wide) * 100 >= F.col("a").cast(wide) * cover)
    kept = least_cut.join(longer, "phrase", "left").where(~held).drop("b")

    spelt = kept.select("phrase", F.posexplode("phrase").alias("at", "id")).join(never_broadcast(words.select("id", "lang", "word")), "id")
    spelt = spelt.groupBy("phrase").agg(F.first("lang").alias("lang"), F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("words"))
    out = kept.join(spelt, "phrase").join(totals, "lang")
    return out.select("lang", F.array_join("words", " ").alias("phrase"), "words", "a", "l", "r", "n", "score")


def top(found: DataFrame, first: int = 2000) -> DataFrame:
    """The first phrases of every language by score, then occurrences, both descending, then the phrase's bytes; with `rank` from 1.

    The first ones of each of PARTS parts of a language are ranked first, so a language never sends more than PARTS * first
    rows to one task.
    """
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    inner = Window.partitionBy("lang", "part").orderBy(*order)
    near = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", F.row_number().over(inner)).where(F.col("rank") <= first)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return ranked.withColumn("rank", F.col("rank").cast("long")).drop("part")
