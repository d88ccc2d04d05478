"""Stages of the pipeline against their own rules."""

import random
import string

import corpus_pipeline
from pyspark.sql import functions as F

from voxelloom.llm import decontam, langid, simhash, tokens
from voxelloom.llm.setup import ready


OTHER = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
    "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    "Minden emberi lény szabadon születik és egyenlő méltósága és joga van.",
]


def test_unlearned_languages_and_letter_noise_go(spark, sf):
    docs = ready(spark).read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(2)
    noise = [" ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 10))) for _ in range(n)) for n in (10, 40, 150, 400)]
    rows = [(10 ** 6 + i, t, None, "x", len(t)) for i, t in enumerate(OTHER + noise)]
    more = spark.createDataFrame(rows, docs.schema)
    own = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(more), sf).collect()} == own


def test_pipeline_of_an_empty_table(spark, sf):
    docs = ready(spark).read.parquet(f"{sf}/documents.parquet")
    left = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, sf)
        assert left.count() == 0


def test_clean_keeps_rows_with_null_ids_and_columns_of_any_name(spark):
    text = "one two three four five six seven"
    rows = [(1, text, 5, "a"), (2, text, 6, "b"), (1, text, 7, "c"), (None, text, 8, "d"), (3, None, 9, "e"), (4, " ", 9, "f")]
    docs = ready(spark).createDataFrame(rows, "doc_id long, text string, __id int, __key string")
    assert sorted(r["__key"] for r in simhash.clean(docs).collect()) == ["a", "c", "d", "e"]


def test_a_label_whose_text_is_repeated_is_learned(spark, sf):
    docs = ready(spark).read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    for word in ("zuzu", "xoxo", "qiqi"):  # whatever the text's hash is
        text = f"{word} kala {word} mana " * 8
        copies = spark.range(20_000).select((-F.col("id") - 1).alias("doc_id"), F.lit(text).alias("text"), F.lit("zz").alias("lang"))
        model = langid.fit(docs.unionByName(copies))
        assert "zz" in model.langs
        assert langid.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first().lang_pred == "zz"


def test_the_sample_takes_every_text_before_copies(spark):
    rows = [(f"text number {i} here", "a") for i in range(30)] + [("the same", "a")] * 500 + [("once", "b")]
    docs = ready(spark).createDataFrame(rows, "text string, lang string")
    seen = []

    class Spy(langid.Model):
        def __init__(self, samples):
            seen.extend(lang for lang, _, _ in samples)
            super().__init__(samples)

    original, langid.Model = langid.Model, Spy
    try:
        langid.fit(docs, per_language=40)
    finally:
        langid.Model = original
    pieces = {lang: seen.count(lang) for lang in "ab"}
    assert pieces["b"] >= 1 and 40 <= pieces["a"] <= 40 * 6  # every sampled text gives itself and up to five excerpts


def test_a_repeated_benchmark_row_counts_once(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = ready(spark).createDataFrame([(1, "a b " + item), (2, "nothing here")], "doc_id long, text string")
    items = spark.range(5000).select(F.lit(7).alias("item_id"), F.lit(item).alias("text"))
    got = {r.doc_id: (r.n_hit, list(r["items"])) for r in decontam.scan(docs, items, block_bytes=4096).collect()}
    assert got == {1: (20, [7]), 2: (0, [])}


def test_repeated_rows_of_one_document_fill_many_files(spark):
    import public_tokenizers

    rows = ready(spark).range(3000).select(F.when(F.col("id") < 2000, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("some words " * 20).alias("text"))
    files = tokens.write(rows, tokens.folder(rows), public_tokenizers.path("byte_bpe_50k.json"), 2, file_bytes=20_000)
    sizes = [r.n_docs for r in files.collect()]
    assert sum(sizes) == 3000 and len(sizes) > 20 and max(sizes) < 600
    got = tokens.read(files)
    assert got.where("doc_id = 5").count() == 2000 and got.select("ids_crc32").distinct().count() == 1
