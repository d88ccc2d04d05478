"""Packing and language decisions against plain versions of the same rules."""

import math
import random

import numpy as np
import pytest

from voxelloom.llm import langid, packing
from voxelloom.llm.setup import ready


def plain_fit(sizes, sources, clusters, capacity):
    """Largest pieces first; of all open bins with room and without a conflict the tightest, then the oldest."""
    bins, placed = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [(capacity - b["fill"], n) for n, b in enumerate(bins) if sizes[i] <= capacity - b["fill"] > 0
                and (sources[i] is None or sources[i] not in b["sources"]) and (clusters[i] is None or clusters[i] not in b["clusters"])]
        if fits:
            n = min(fits)[1]
        else:
            n = len(bins)
            bins.append({"fill": 0, "sources": set(), "clusters": set()})
        bins[n]["fill"] += sizes[i]
        bins[n]["sources"].add(sources[i])
        bins[n]["clusters"].add(clusters[i])
        placed[i] = n
    return placed, [b["fill"] for b in bins]


@pytest.mark.parametrize("seed", range(40))
def test_best_fit_equals_a_scan_of_all_bins(seed):
    rng = random.Random(seed)
    n, capacity = rng.randint(0, 120), rng.choice([10, 50, 2048])
    sizes = [rng.choice([0, 1, capacity, rng.randint(0, capacity), rng.randint(0, max(1, capacity // 4))]) for _ in range(n)]
    sources = [rng.choice([None, *"abcdefgh"[:rng.randint(1, 8)]]) for _ in range(n)]
    clusters = [rng.choice([None, None, *range(rng.randint(1, 60))]) for _ in range(n)]
    assert packing.best_fit(sizes, sources, clusters, capacity) == plain_fit(sizes, sources, clusters, capacity)


def test_rows_with_null_ids_are_packed(spark):
    rows = [(None, "a b c", "s"), (None, None, None), (1, "", "s"), (2, "a b c", "t")]
    out = packing.pack(ready(spark).createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(((r.doc_id or -1), r.size) for r in out) == [(-1, 0), (-1, 3), (1, 0), (2, 3)]
    assert packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string").limit(0)).count() == 0


def test_near_copies_of_a_given_cluster_do_not_share_a_bin(spark):
    rows = [(i, f"text {i} " * 20, None, i % 3 if i < 30 else None) for i in range(40)]
    df = ready(spark).createDataFrame(rows, "doc_id long, text string, source string, component long").coalesce(1)
    bins = {}
    for r in packing.pack(df, cluster="component").collect():
        bins.setdefault(r.bin_id, []).append(r.doc_id)
    for held in bins.values():
        known = [i % 3 for i in held if i < 30]
        assert len(known) == len(set(known))


def plain_decision(model, margins):
    """Language and score of one text, machine by machine."""
    sure = {kind: 1 / (1 + math.exp(-max(-30, min(30, 3 * m)))) for kind, m in zip(model.tasks, margins)}
    if len(model.families) == 1:
        chance = {model.families[0]: 1.0}
    elif len(model.families) == 2:
        p = sure["family", model.families[0]]
        chance = dict(zip(model.families, (p, 1 - p)))
    else:
        total = sum(sure["family", f] for f in model.families)
        chance = {f: sure["family", f] / total for f in model.families}
    best = max(model.families, key=lambda f: chance[f])
    members = [x for x in model.langs if langid.family(x) == best]
    votes = {x: sum(sure["pair", x, y] if x < y else 1 - sure["pair", y, x] for y in members if y != x) for x in members}
    won = max(members, key=lambda x: votes[x])
    return won, chance[best] * (votes[won] / (len(members) - 1) if len(members) > 1 else 1.0)


@pytest.mark.parametrize("langs", [["en"], ["en", "de"], ["en", "fr"], ["en", "de", "nl", "fr", "es", "ru", "xx"]])
def test_family_and_votes_equal_a_plain_count(langs):
    rng = np.random.default_rng(len(langs))
    samples = []
    for lang in langs:
        for _ in range(6):
            at = np.sort(rng.choice(langid.SIZE, 30, replace=False))
            samples.append((lang, at.astype(np.int32), rng.random(30).astype(np.float32)))
    model = langid.Model(samples)
    margins = rng.normal(0, 1.5, (200, len(model.bias)))
    got = model.decide(margins)
    for lang, score, m in zip(*got, margins):
        won, want = plain_decision(model, m)
        assert lang == won and score == pytest.approx(want)


def test_margins_are_those_of_the_machines():
    """Weights times features of one text, feature by feature."""
    texts = [b" the cat sat on the mat ", b" der hund und die katze ", b" le chat est sur la table "]
    samples = []
    for lang, text in zip(("en", "de", "fr"), texts):
        n = langid.counts(np.frombuffer(text, np.uint8))
        at = np.flatnonzero(n)
        samples += [(lang, at.astype(np.int32), (n[at] / len(text)).astype(np.float32))] * 3
    model = langid.Model(samples)
    data = np.frombuffer(texts[0] + texts[1], np.uint8)
    got = langid.margins(model, data, np.array([0, len(texts[0]), len(data)]))
    for i, text in enumerate(texts[:2]):
        n = langid.counts(np.frombuffer(text, np.uint8)).astype(float)
        length = math.sqrt(sum((k * s) ** 2 for k, s in zip(n, model.scale)))
        for t in range(len(model.bias)):
            assert got[i, t] == pytest.approx(sum(k * w for k, w in zip(n, model.table[:, t].astype(float))) / length + model.bias[t], abs=1e-4)
