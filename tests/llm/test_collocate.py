"""Automata against dictionaries; collocations against plain counting."""

import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute as X
from voxelloom.llm import automata as A
from voxelloom.llm import collocate as C
from voxelloom.llm.setup import ready, stored

PHRASES = st.dictionaries(st.tuples(*[st.integers(1, 4)] * 4).flatmap(lambda p: st.integers(1, 4).map(lambda n: p[:n] + (0,) * (4 - n))), st.integers(1, 50), max_size=60)


def arrays(counted):
    rows = np.array(sorted(counted), dtype=np.int64).reshape(-1, 4)
    return rows, np.array([counted[tuple(r)] for r in rows.tolist()], dtype=np.int64)


def prefixes(counted):
    out = Counter()
    for phrase, n in counted.items():
        real = [x for x in phrase if x]
        for k in range(1, len(real) + 1):
            out[tuple(real[:k])] += n
    return out


def read(tree):
    return {tuple(r): int(w) for rows, weight in A.phrases(tree) for r, w in zip(rows.tolist(), weight)}


@settings(max_examples=60, deadline=None)
@given(st.lists(PHRASES, min_size=1, max_size=4), st.integers(1, 9), st.integers(1, 60))
def test_automata_count_unite_prune_and_compose(shards, run, least):
    built, want = [], Counter()
    for counted in shards:
        builder = A.Builder()
        for part in A.runs(A.levels(*arrays(counted))[0], run):
            builder.add(part)
        whole, data = A.build(A.levels(*arrays(counted))[0]), builder.finish().dumps()
        built.append(A.loads(data))
        assert len(built[-1].size) == len(whole.size) and built[-1].label.sum() == whole.label.sum()
        want += prefixes(counted)
    tree = A.union(built, 4)
    assert read(tree) == want
    spared = np.array([1, 2, 3, 0])
    pruned = A.prune(tree, least, [spared])
    kept = {p: n for p, n in want.items() if n >= least or list(p) == spared[:len(p)].tolist()}
    assert read(pruned) == kept
    counts = A.build(pruned)
    asked = np.array(sorted({(a, b, c, 0 if c == 0 else d) for a in range(1, 5) for b in range(5) for c in (range(5) if b else [0]) for d in range(5)}))
    assert A.compose(asked, counts).tolist() == [kept.get(tuple(x for x in p if x), 0) for p in asked.tolist()]


def test_equal_states_are_one():
    counted = {(a, 7, 8, 9): 3 for a in range(1, 200)}
    automaton = A.build(A.levels(*arrays(counted))[0])
    assert len(automaton.size) == 5  # one state a length, though 199 phrases


@settings(max_examples=60, deadline=None)
@given(st.lists(PHRASES, min_size=1, max_size=4), st.integers(1, 60), st.lists(st.tuples(*[st.integers(1, 4)] * 4), max_size=2))
def test_union_that_drops_at_once_equals_pruning_afterwards(shards, least, spared):
    dumped, spared = [A.build(A.levels(*arrays(c))[0]).dumps() for c in shards], [np.array(s) for s in spared]
    got = A.union((A.loads(d) for d in dumped), 4, least, spared)
    want = A.prune(A.union([A.loads(d) for d in dumped], 4), least, spared)
    assert all(x.tolist() == y.tolist() for a, b in zip(got, want) for x, y in zip(a, b)) and len(got) == len(want) == 4


def test_union_holds_what_is_frequent():
    rng = np.random.default_rng(2)
    rows = np.unique(rng.integers(1, 1 << 20, (200_000, 4)), axis=0)
    dumped = [A.build(A.levels(rows[i::4], np.ones(len(rows[i::4]), np.int64))[0]).dumps() for i in range(4)]
    tracemalloc.start()
    tree = A.union((A.loads(d) for d in dumped), 4, 30)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(level.label) for level in tree] == [0] * 4 and most < 60_000_000  # 34 MB; 94 MB when all arrays were widened and the tree pruned at the end


def plain(rows, least=30, longest=4):
    """rows: (text, lang) -> {(lang, phrase): (a, l, r, n, score)}."""
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", X.lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i:i + k])] += 1
    often = {x: a for x, a in counts.items() if a >= least and len(x[1]) > 1}
    out = {}
    for (lang, w), a in often.items():
        score, _, l, r = min((2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
        inside = [b for (m, v), b in often.items() if m == lang and len(v) > len(w) and any(v[i:i + len(w)] == w for i in range(len(v)))]
        if not any(100 * b >= 80 * a for b in inside):
            out[lang, " ".join(w)] = (a, l, r, total[lang], score)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    common = [f"w{i}" for i in range(12)] + ["Ärger", "the\tbig", "New York", "x\x0by", "a,b"]
    rows = [(" ".join(rng.choice(common, rng.integers(0, 60))), ["en", None, "und", "de"][int(rng.integers(0, 4))]) for _ in range(150)]
    rows += [("hot pair " + " ".join(f"r{x}" for x in rng.integers(0, 40, 3)) + ". Hot pair goes far", "en") for _ in range(400)]
    rows += [(None, "en"), ("", "de"), (" \t. ,", "en"), ("one two three four five " * 40, "de"), ("same line same line, " * 2, "fr")]
    return rows + [("long " + " ".join(rng.choice(common, 30_000)), "en")] + [("copy of a line", "es")] * 30


@pytest.mark.parametrize("options", [{}, {"range_words": 500}])
def test_collocations_equal_plain_counting(spark, rows, monkeypatch, options):
    monkeypatch.setattr(C, "STRIDE", 16)
    df = ready(spark).createDataFrame([(*r, "a", 1) for r in rows], "text string, lang string, word string, n int").repartition(3)
    got = {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in C.mine(df, **options).collect()}
    want = plain(rows)
    assert got == want and len(want) > 100
    first = C.top(C.mine(df, **options), 7).orderBy("lang", "rank").collect()
    for lang in {k[0] for k in want}:
        order = sorted(((-v[4], -v[0], k[1].encode()) for k, v in want.items() if k[0] == lang))[:7]
        assert [(-r.score, -r.a, r.phrase.encode()) for r in first if r.lang == lang] == order
        assert [r.rank for r in first if r.lang == lang] == list(range(1, len(order) + 1))


def test_ranges_stay_even_when_there_are_many(spark, monkeypatch):
    monkeypatch.setattr(C, "SHARD_WORDS", 2048)
    monkeypatch.setattr(C, "STRIDE", 512)  # four phrases a shard, and shards that are alike
    rng = np.random.default_rng(3)
    docs = [(" ".join(f"w{x}" for x in rng.integers(0, 4000, 64)), "en") for _ in range(2048)]
    df = ready(spark).createDataFrame(docs, "text string, lang string").coalesce(4)
    _, _, transducers, bounds = C.count(df, least=1, range_words=1024)
    held = [int(A.union([A.loads(r.block)], 4)[0].weight.sum()) for r in transducers.collect()]
    assert sum(held) == 2048 * 64 and len(bounds) > 100 and max(held) < 4 * 1024


def test_large_rows_make_small_groups(spark):
    ready(spark)
    rows = spark.range(12).coalesce(1).mapInArrow(
        lambda batches: (pa.RecordBatch.from_pydict({"x": [np.random.default_rng(i).bytes(4 << 20)]}) for b in batches for i in b.column(0).to_pylist()), "x binary")
    files = [f.removeprefix("file://") for f in stored(rows, "large", **C.LARGE_ROWS).inputFiles()]
    groups = [g for m in (pq.ParquetFile(f).metadata for f in files) for g in (m.row_group(i).num_rows for i in range(m.num_row_groups))]
    assert sum(groups) == 12 and max(groups) <= 5


def test_no_documents_and_no_frequent_words(spark):
    df = ready(spark).createDataFrame([("a b c", "en"), (None, None)], "text string, lang string")
    assert C.mine(df).count() == 0 and C.mine(df.limit(0)).count() == 0


def test_shards_hold_whole_pieces(spark, monkeypatch):
    rows = [("a b c. d e " * 5 + "f" * 50, "en"), ("x. y. z", "de")] * 4
    df = ready(spark).createDataFrame(rows, "text string, lang string").coalesce(1)
    words = Counter()
    for r in C.shards(df).collect():
        tokens = np.frombuffer(r.tokens, np.int32)
        assert tokens[0] == 0 and sum(w.n for w in r.words) == int((tokens > 0).sum())
        for w in r.words:
            words[w.lang, w.word] += w.n
    assert words["en", "a"] == 20 and words["de", "z"] == 4 and sum(words.values()) == 4 * (5 * 5 + 1 + 3)
