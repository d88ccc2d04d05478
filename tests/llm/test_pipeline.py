"""The pipeline, stage by stage, on the smallest tables."""

import corpus_pipeline
from tests.llm import brute as X
from voxelloom.llm.setup import ready, stored


def test_stages_decide_as_the_plain_versions_do(spark, sf):
    docs = ready(spark).read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
        after = docs.collect()
        if name != "pack":
            assert docs.columns == columns
            after = {r.doc_id: r for r in after}
        if name == "language":
            assert set(before) - set(after) == {d for d, r in before.items() if not any(c.isalpha() for c in r.text or "")}
        if name == "near_copies":
            assert set(after) == set(X.groups({d: X.simhash(r.text) for d, r in before.items()}).values())
        if name == "repeated_text":
            for d, _, gone, kept in X.substring([(d, r.text) for d, r in before.items()]):
                assert after[d].text == (kept if gone else before[d].text) and after[d].n_chars == len(after[d].text)
        if name == "decontaminate":
            found = X.decontaminate([(d, r.text) for d, r in before.items()], items)
            assert set(after) == {d for d, (n, hit, _) in found.items() if not (hit and 20 * hit >= n)}
            assert all(after[d] == before[d] for d in after)
        if name == "pack":
            sizes = {}
            for r in after:
                sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.size
            assert sizes == {d: len(X.blank_words(r.text)) for d, r in before.items()}
        before = after


def test_run_returns_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "piece", "first", "size", "bin_id", "slot", "bin_fill"] and out.count() > 0
